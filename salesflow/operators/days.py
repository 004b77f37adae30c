"""Days with sales per series as bitmaps, so that an upload is added without counting a series again.

Days are counted from the first of year 1, and a series has one row per span of 32 768 of them, some ninety years. Days that
come again set bits that are set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesflow.schemas import SERIES
from salesflow.session import discard, materialize
from salesflow.sources.folders import exists

PARTS = 64
SPAN = 32768  # days, bits of one of Spark's bitmaps
FIRST = 719_162  # days from the first of year 1 to 1970
DAYS = "user_id string, sku string, span bigint, days binary, part int"


def day_bitmaps(sales: DataFrame, day: str = "date") -> DataFrame:
    """Bitmaps of the days of each series; combined before the shuffle, so a series of many rows sends one row per task."""
    number = F.unix_date(day).cast("bigint") + FIRST + 1  # bit numbers start from one
    rows = sales.filter(F.col(day).isNotNull()).withColumns({
        "span": F.bitmap_bucket_number(number), "_bit": F.bitmap_bit_position(number), "part": F.pmod(F.xxhash64(*SERIES), F.lit(PARTS)).cast("int")})
    return rows.groupBy(*SERIES, "span", "part").agg(F.bitmap_construct_agg("_bit").alias("days")).select(*SERIES, "span", "days", "part")


def add_days(spark: SparkSession, sales: DataFrame, path: str, day: str = "date") -> None:
    """Add the days of an upload to the stored bitmaps; only the folders of its series are read and written."""
    fresh = materialize(day_bitmaps(sales, day), "days")
    touched = [r[0] for r in fresh.select("part").distinct().collect()]  # at most PARTS
    rows = fresh
    if exists(spark, path):
        rows = spark.read.schema(DAYS).parquet(path).filter(F.col("part").isin(touched)).unionByName(fresh)
    merged = rows.groupBy(*SERIES, "span", "part").agg(F.bitmap_or_agg("days").alias("days"))
    merged.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    discard(fresh)


def last_bit(bitmap: Column) -> Column:
    """Highest bit that is set, from zero on."""
    text = F.regexp_replace(F.hex(bitmap), "(00)+$", "")
    byte = F.conv(F.right(text, F.lit(2)), 16, 10).cast("int")
    return (F.length(text) / 2 - 1).cast("bigint") * 8 + F.floor(F.log2(byte)).cast("bigint")


def day_stats(stored: DataFrame) -> DataFrame:
    """sales_days and last_sale_date of each series."""
    last = (F.col("span") - 1) * SPAN + last_bit(F.col("days")) - FIRST
    return stored.groupBy(*SERIES).agg(
        F.sum(F.bitmap_count("days")).cast("int").alias("sales_days"), F.date_from_unix_date(F.max(last).cast("int")).alias("last_sale_date"))


def touched_stats(spark: SparkSession, path: str, sales: DataFrame) -> DataFrame:
    """The same for the series of an upload, from their folders only: what ``update_by_key`` writes into the products."""
    parts = [r[0] for r in sales.select(F.pmod(F.xxhash64(*SERIES), F.lit(PARTS)).cast("int")).distinct().collect()]
    stored = spark.read.schema(DAYS).parquet(path).filter(F.col("part").isin(parts))
    return day_stats(stored.join(sales.select(*SERIES).distinct(), SERIES, "left_semi"))
