"""Upsert, update, delete and retention on keyed tables, as DataFrame functions and on stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesflow.functions.scalars import batch_id
from salesflow.operators.keyed import latest, top_n
from salesflow.session import discard, materialize
from salesflow.sources.folders import drop_folder, exists


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``updates`` replace or extend ``target``; columns the updates lack keep their value.

    Several updates of one key are decided by ``order``, newest last.
    """
    if order:
        updates = latest(updates, keys, order)
    given = [c for c in updates.columns if c in target.columns and c not in keys]
    newer = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_updated"))
    joined = target.join(newer, keys, "full")
    return joined.select(*[
        F.when(F.col("_updated"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
        for c in target.columns])


def update_by_key(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Set columns on rows whose key occurs in ``updates`` (unique per key); other rows stay."""
    newer = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_updated"))
    joined = target.join(newer, keys, "left")
    return joined.select(*[
        F.when(F.col("_updated"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in target.columns])


def delete_by_key(target: DataFrame, keys_to_delete: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(keys_to_delete.select(*keys).distinct(), keys, "left_anti")


def prune(df: DataFrame, as_of: Column, column: str, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``."""
    return df.filter(F.col(column) >= as_of - F.expr(f"interval {days} days"))


def prune_runs(df: DataFrame, as_of: Column, days: int = 7, column: str = "model_run_id") -> DataFrame:
    """Keep batch ids of the last ``days``; nightly ids sort by run day."""
    return df.filter(F.col(column) >= batch_id(F.date_sub(as_of, days)))


def keep_runs(df: DataFrame, n: int = 7) -> DataFrame:
    """Rows of the newest ``n`` runs of each tenant.

    Runs are ranked on their distinct list, not on the forecast rows.
    """
    runs = df.groupBy("user_id", "model_run_id").agg(F.max("generated_at").alias("generated_at"))
    kept = top_n(runs, ["user_id"], [F.desc("generated_at"), F.desc("model_run_id")], n)
    return df.join(kept.select("user_id", "model_run_id"), ["user_id", "model_run_id"], "left_semi")


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], partition: str,
                 order: list[str] | None = None) -> None:
    """Upsert into a stored table; only the partitions named by the updates are read and rewritten.

    ``partition`` must be one of the keys, so that a key never changes its partition.
    """
    if partition not in keys:
        raise ValueError("the partition column must be part of the key")
    if order:
        updates = latest(updates, keys, order)
    if exists(spark, path):
        touched = updates.select(partition).distinct()
        stored = spark.read.schema(updates.schema).parquet(path).select(*updates.columns)
        updates = upsert(stored.join(touched, partition, "left_semi").select(*stored.columns), updates, keys)
    # Rebalanced files: small partitions share a task, a large one is split over several.
    updates.hint("rebalance", partition).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def delete_table(spark: SparkSession, path: str, schema: str, partition: str, condition: Column) -> None:
    """Delete the rows of a stored table that meet ``condition``; only partitions that hold such rows are touched.

    A partition that loses all its rows is removed, others are rewritten. The list of partitions is the table's own;
    rows stay on the executors. Repeating a delete changes nothing.
    """
    if not exists(spark, path):
        return
    stored = spark.read.schema(schema).parquet(path)
    gone = F.coalesce(condition, F.lit(False))
    touched = stored.groupBy(partition).agg(F.count_if(gone).alias("gone"), F.count_if(~gone).alias("kept")).filter("gone > 0")
    touched = materialize(touched, "touched")
    rewritten = touched.filter("kept > 0").select(partition)
    if not rewritten.isEmpty():
        # Written aside first: a table cannot be read and replaced in one go.
        kept = materialize(stored.join(rewritten, partition, "left_semi").filter(~gone).select(*stored.columns), "kept")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        discard(kept)
    for row in touched.filter("kept = 0").select(F.col(partition).cast("string")).toLocalIterator():
        drop_folder(spark, path, {partition: row[0]})
    discard(touched)
