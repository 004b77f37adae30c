"""Retention by a ledger of zones: smallest and largest time of each folder, kept when rows are written.

The ledger is a small table beside the data (``_zones``, which readers pass over), a row per folder and write. Old rows are found in it
without opening a data file: folders that are old as a whole are removed, only those at the limit are read. It is only ever
added to: a folder that is removed or rewritten gets a row that makes the earlier ones void, so a run that is cut off leaves a
ledger that is right. One writer at a time.
"""

from __future__ import annotations

import time as clock

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesflow.session import discard, materialize
from salesflow.sources.folders import drop_folder, exists

FACTS = "lo timestamp, hi timestamp, undated bigint, version bigint, void boolean"


def schema_of(folders: list[str]) -> str:
    return ", ".join([*[f"{c} string" for c in folders], FACTS])


def add_zones(rows: DataFrame, path: str, folders: list[str], time: str | None, void: bool = False) -> None:
    """Enter rows that are about to be written; with ``void`` they are all that their folders hold from now on."""
    at = F.lit(None).cast("timestamp") if time is None else F.col(time).cast("timestamp")
    found = rows.groupBy(*[F.col(c).cast("string").alias(c) for c in folders]).agg(
        F.min(at).alias("lo"), F.max(at).alias("hi"), F.count_if(at.isNull()).alias("undated"))
    entered = found.withColumns({"version": F.lit(clock.time_ns()), "void": F.lit(void)})
    entered.coalesce(1).write.mode("append").parquet(f"{path}/_zones")


def append_with_zones(df: DataFrame, path: str, folders: list[str], time: str | None) -> None:
    """Append rows, one folder per value of ``folders``, and their zones. The zones come first: they may name too much, never too little.

    Rows are dealt by folder before they are written, so a write leaves few files whatever the number of tasks.
    """
    add_zones(df, path, folders, time)
    df.hint("rebalance", *folders).write.mode("append").partitionBy(*folders).parquet(path)


def zones(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """Smallest and largest time of each folder that holds rows, and how many have none (a time that is missing is never old)."""
    held = spark.read.schema(schema_of(folders)).parquet(f"{path}/_zones")
    found = held.groupBy(*folders).agg(F.max(F.when(F.col("void"), F.col("version"))).alias("since"), F.collect_list(F.struct("version", "lo", "hi", "undated")).alias("w"))
    valid = F.filter("w", lambda w: w["version"] >= F.coalesce("since", F.lit(0)))
    return found.select(*folders, F.array_min(F.transform(valid, lambda w: w["lo"])).alias("lo"), F.array_max(F.transform(valid, lambda w: w["hi"])).alias("hi"),
                        F.aggregate(valid, F.lit(0).cast("bigint"), lambda n, w: n + w["undated"]).alias("undated")).filter("lo IS NOT NULL OR undated > 0")


def old_folders(spark: SparkSession, path: str, folders: list[str], before: Column) -> DataFrame:
    """Folders with rows older than ``before``; ``whole`` where all of them are. Reads the ledger only."""
    held = zones(spark, path, folders).filter(F.col("lo") < before)
    return held.select(*folders, ((F.col("hi") < before) & (F.col("undated") == 0)).alias("whole"))


def prune_zones(spark: SparkSession, path: str, schema: str, folders: list[str], time: str, before: Column) -> tuple[int, int]:
    """Remove rows older than ``before``; the number of folders removed, and of those rewritten. Repeating it changes nothing."""
    if not exists(spark, f"{path}/_zones"):
        return 0, 0
    found = materialize(old_folders(spark, path, folders, before), "old")
    edge, whole = found.filter("NOT whole").drop("whole"), found.filter("whole").drop("whole")
    rewritten = edge.count()
    if rewritten:
        near = spark.read.schema(schema).parquet(path)
        for c in folders:  # only folders around the limit are mixed: their values cut the scan
            values = [r[0] for r in edge.select(c).distinct().collect()]
            listed = F.coalesce(F.col(c).cast("string").isin([v for v in values if v is not None]), F.lit(False))
            near = near.filter(listed | F.col(c).isNull() if None in values else listed)
        on = [F.col(f"a.{c}").cast("string").eqNullSafe(F.col(f"b.{c}")) for c in folders]
        kept = materialize(near.alias("a").join(edge.alias("b"), on, "left_semi").filter(F.coalesce(F.col(time) >= before, F.lit(True))), "kept")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
        add_zones(kept, path, folders, time, void=True)
        discard(kept)
    removed = 0
    for row in whole.toLocalIterator():
        drop_folder(spark, path, dict(zip(folders, row)))
        removed += 1
    if removed:
        gone = whole.withColumns({"lo": F.lit(None).cast("timestamp"), "hi": F.lit(None).cast("timestamp"), "undated": F.lit(0).cast("bigint"),
                                  "version": F.lit(clock.time_ns()), "void": F.lit(True)})
        gone.coalesce(1).write.mode("append").parquet(f"{path}/_zones")
    discard(found)
    return removed, rewritten
