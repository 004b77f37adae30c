"""Stored serving tables: written per run in the order in which they are read, visible run by run.

Rows are dealt into buckets of (tenant, SKU), one folder each, and sorted by them, with Bloom filters on the SKU. A read of a few SKUs
works out their buckets, opens these folders only and skips the row groups that hold none of them. A small table of the
tenants of each run tells which run is a tenant's newest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesflow.plans.serving import assemble_series, latest_run
from salesflow.schemas import FORECAST_FACTORS, FORECASTS, GOLD_METRICS, SERIES
from salesflow.sources import snapshots

BUCKETS = 32
TENANTS = "user_id string, model_run_id string, generated_at timestamp"
BUCKETED = {"forecasts": f"{FORECASTS}, bucket int", "forecast_factors": f"{FORECAST_FACTORS}, bucket int"}
TABLES = {**BUCKETED, "gold_model_metrics": GOLD_METRICS, "tenants": TENANTS}


def bucket_of(user: Column, sku: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(user, sku), F.lit(buckets)).cast("int")


def write_serving(df: DataFrame, path: str, order: list[str], buckets: int = BUCKETS) -> None:
    """Write rows by bucket, sorted by series and ``order``."""
    placed = df.withColumn("bucket", bucket_of(F.col("user_id"), F.col("sku"), buckets))
    writer = placed.repartition("bucket").sortWithinPartitions("bucket", *SERIES, *order).write
    for column in SERIES:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.partitionBy("bucket").parquet(path)


def read_series(stored: DataFrame, wanted: list[tuple[str, str]], buckets: int = BUCKETS) -> DataFrame:
    """Rows of a few (tenant, SKU) pairs from a table with ``bucket``; everything else is left closed.

    The pairs are those of one request, at most ten.
    """
    spark = stored.sparkSession
    pairs = spark.createDataFrame(wanted, "user_id string, sku string")
    places = sorted({r[0] for r in pairs.select(bucket_of(F.col("user_id"), F.col("sku"), buckets)).collect()})
    own = F.lit(False)
    for user, sku in wanted:
        own = own | ((F.col("user_id") == user) & (F.col("sku") == sku))
    return stored.filter(F.col("bucket").isin(places) & F.col("user_id").isin(sorted({u for u, _ in wanted})) & F.col("sku").isin(
        sorted({k for _, k in wanted})) & own).drop("bucket")


def run_tables(forecasts: DataFrame, factors: DataFrame, buckets: int = BUCKETS) -> dict:
    """How to write the serving tables of a run, by name."""
    tenants = latest_run(forecasts)
    return {
        "forecasts": lambda path: write_serving(forecasts, path, ["forecast_date"], buckets),
        "forecast_factors": lambda path: write_serving(factors, path, ["factor"], buckets),
        "tenants": lambda path: tenants.repartitionByRange("user_id").sortWithinPartitions("user_id").write.parquet(path)}


def stored(spark: SparkSession, root: str, name: str, runs: tuple[snapshots.Run, ...] | None = None) -> DataFrame:
    """A table of all visible runs, or of the given ones."""
    held = snapshots.current(spark, root) if runs is None else snapshots.Snapshot(0, tuple(runs))
    return held.table(spark, root, name, TABLES[name])


def serve(spark: SparkSession, root: str, user: str, skus: list[str], horizon: int, health: DataFrame, as_of: Column,
          buckets: int = BUCKETS) -> DataFrame:
    """Points and factors of a tenant's SKUs from its newest run, as ``assemble_series`` gives them; no row without a run."""
    seen = snapshots.current(spark, root)
    mine = stored(spark, root, "tenants", seen.runs).filter(F.col("user_id") == user)
    newest = latest_run(mine).first()
    runs = tuple(r for r in seen.runs if newest and r.id == newest.model_run_id)
    wanted = [(user, sku) for sku in skus]
    asked = spark.createDataFrame([(user, i, sku, horizon) for i, sku in enumerate(skus)], "user_id string, position int, sku string, horizon int")
    forecasts, factors = (read_series(stored(spark, root, n, runs), wanted, buckets) for n in BUCKETED)
    run = spark.createDataFrame([tuple(newest)] if newest else [], TENANTS)
    return assemble_series(asked, forecasts, factors, health, as_of, run)
