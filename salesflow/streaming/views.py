"""Tables that micro-batches keep up to date: partial counts applied once, and the newest version of every key.

Both take batches in any order and any number of times. Neither reads what earlier batches brought: a batch meets the
stored rows of its own keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesflow.operators.keyed import latest
from salesflow.session import discard, materialize
from salesflow.sources.folders import exists

DAYS_LISTED = 400  # a batch of more days is met by their range
BUCKETS = 64
SLOTS = 16  # bitmaps of 32 768 bits in the filter of a bucket
BITS = 32768


def of_days(stored: DataFrame, batch: DataFrame, day: str) -> DataFrame:
    """The folders of ``stored`` that hold the batch's days; others are not listed for reading."""
    days = [r[0] for r in batch.select(day).distinct().limit(DAYS_LISTED + 1).collect()]
    if len(days) <= DAYS_LISTED:
        return stored.filter(F.col(day).isin(days))
    span = batch.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    return stored.filter(F.col(day).between(span.a, span.b))


def apply_once(partials: DataFrame, number: int, table: str, keys: list[str], day: str) -> None:
    """Add a batch's partial counts to ``table``: one row per (*keys, day), one folder per day.

    All other columns of ``partials`` are counts. A row lists the batches it holds (``batches``), so a batch that comes again
    changes nothing, also where it was cut off between two folders. Only the folders of the batch's days are read and
    written. The list of a row is as long as batches have met its key and day.
    """
    spark = partials.sparkSession
    counts = [c for c in partials.columns if c not in (*keys, day)]
    fresh = materialize(partials.filter(F.col(day).isNotNull()).groupBy(*keys, day).agg(*[F.sum(c).alias(c) for c in counts]), "partials")
    rows = fresh.withColumns({"batches": F.array(F.lit(number).cast("bigint")), "new": F.lit(True)})
    if exists(spark, table):
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema.fields if f.name != day)
        stored = of_days(spark.read.schema(f"{schema}, batches array<bigint>, {day} {fresh.schema[day].dataType.simpleString()}").parquet(table), fresh, day)
        rows = rows.unionByName(stored.withColumn("new", F.lit(False)))
    known = F.coalesce(F.max(F.when(~F.col("new"), F.array_contains("batches", number))), F.lit(False))
    merged = rows.groupBy(*keys, day).agg(
        *[(F.coalesce(F.sum(F.when(~F.col("new"), F.col(c))), F.lit(0)) + F.when(known, 0).otherwise(F.coalesce(F.sum(F.when(F.col("new"), F.col(c))), F.lit(0)))
           ).alias(c) for c in counts],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("batches")))).alias("batches"))
    merged.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(table)
    discard(fresh)


def bit_set(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set; the lowest bit of a byte comes first."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def placed(rows: DataFrame, keys: list[str], buckets: int, slots: int) -> DataFrame:
    """Adds the bucket of a row's key, and its place in the bucket's filter (slot, bit)."""
    own = F.xxhash64(*keys)
    spread = F.xxhash64(own, F.lit(7))
    return rows.withColumns({"bucket": F.pmod(own, F.lit(buckets)).cast("int"), "slot": F.pmod(spread, F.lit(slots)).cast("int"),
                             "bit": F.pmod(F.shiftright(spread, 20), F.lit(BITS)).cast("int")})


def merge_versions(batch: DataFrame, store: str, keys: list[str], order: list[str], buckets: int = BUCKETS, slots: int = SLOTS) -> None:
    """Keep the newest version of every key ever seen; ``order`` decides, an older copy that comes late changes nothing.

    Rows live in ``store/rows``, a folder per bucket of keys. ``store/filters`` has a bitmap per bucket and slot of the keys it may hold: a
    bucket of which the batch only has keys that are certainly new is added to without being read, all others are rewritten.
    Filters are written first, so a batch that was cut off finds its keys marked and is merged when it comes again. A full filter
    costs reading, never a row; ``buckets`` times ``slots`` times 32 768 bits should be some times the number of keys.
    """
    spark = batch.sparkSession
    rows = materialize(placed(latest(batch, keys, order), keys, buckets, slots), "versions")
    filters, stored = f"{store}/filters", f"{store}/rows"
    places = "slot int, marks binary, bucket int"
    known, old = rows.limit(0).select("bucket"), spark.createDataFrame([], places)
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
    if exists(spark, filters):
        old = spark.read.schema(places).parquet(filters).filter(F.col("bucket").isin(touched))
        known = rows.join(old, ["bucket", "slot"]).filter(bit_set(F.col("marks"), F.col("bit"))).select("bucket")
    rewritten = [r[0] for r in known.distinct().collect()]
    marks = rows.groupBy("bucket", "slot").agg(F.bitmap_construct_agg("bit").alias("marks"))
    both = old.select("bucket", "slot", "marks").unionByName(marks).groupBy("bucket", "slot").agg(F.bitmap_or_agg("marks").alias("marks"))
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(filters)
    kept = rows.drop("slot", "bit")
    if rewritten and exists(spark, stored):
        before = spark.read.schema(kept.schema).parquet(stored).select(*kept.columns).filter(F.col("bucket").isin(rewritten))
        newest = latest(before.unionByName(kept.filter(F.col("bucket").isin(rewritten))), keys, order)
        newest.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(stored)
        kept = kept.filter(~F.col("bucket").isin(rewritten))
    kept.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(stored)
    discard(rows)


def versions(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """The newest version of every key of a store."""
    return spark.read.schema(schema).parquet(f"{store}/rows").drop("bucket")
