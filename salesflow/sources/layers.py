"""Layer tables on shared storage: read, append, overwrite, look back, partitioned JDBC read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesflow.operators.zones import append_with_zones
from salesflow.sources.folders import exists


def read_layer(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A layer table; empty with the declared schema when it was never written."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def append_bronze(df: DataFrame, path: str, day: str = "observed_at") -> None:
    """Append envelopes, one folder per source and observed day, so that a reader of one source opens its files only.

    The times of ingest of each folder are kept in a ledger, from which old rows are pruned; rows without that column are
    entered as undated and are never old.
    """
    rows = df.withColumn("observed_date", F.col(day).cast("date"))
    append_with_zones(rows, path, ["source", "observed_date"], "ingested_at" if "ingested_at" in df.columns else None)


def overwrite_layer(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace a layer table, or only the partitions that occur in ``df``; nothing happens when it is empty."""
    writer = df.write.mode("overwrite")
    if partition:
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    elif not df.isEmpty():
        writer.parquet(path)


def lookback(df: DataFrame, as_of: Column, days: int = 400, day: str = "observed_at") -> DataFrame:
    """Rows of the last ``days``; prunes partitions when ``day`` is the partition column."""
    return df.filter(F.col(day) >= F.date_sub(as_of, days))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int,
              **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric column, instead of page by page."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(parts), **options).load()
