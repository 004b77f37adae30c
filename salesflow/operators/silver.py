"""Bronze to Silver: deduplication, gap flags, daily event counts, forward fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from salesflow.functions.scalars import clamp
from salesflow.operators.keyed import latest
from salesflow.schemas import SERIES, SERIES_DAY


def by_series() -> Window:
    """Rows of a series in date order; a deduplicated series has at most one row per calendar day."""
    return Window.partitionBy(*SERIES).orderBy("date")


def dedupe_latest(sales: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Latest ingested record per series and day; ``order`` ends in a total order of the input."""
    return latest(sales, SERIES_DAY, order or ["ingested_at", "seq"])


def latest_per_day(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    return latest(df, [*keys, "date"], order or ["ingested_at", "seq"])


def after_gap() -> Column:
    """True on the row that follows a hole of more than one day."""
    return F.coalesce(F.date_diff("date", F.lag("date").over(by_series())) > 1, F.lit(False))


def flag_gaps(daily: DataFrame) -> DataFrame:
    return daily.withColumn("gap_flag", after_gap())


def enforce_types(daily: DataFrame) -> DataFrame:
    """Quantity at least zero; quantity, revenue and price may be missing, promo defaults to false."""
    return daily.select(
        *SERIES_DAY,
        clamp(F.col("quantity").cast("double"), 0).alias("quantity"),
        F.col("revenue").cast("double").alias("revenue"),
        F.col("price").cast("double").alias("price"),
        F.coalesce(F.col("promo_flag"), F.lit(False)).alias("promo_flag"),
    )


def to_silver(sales: DataFrame, order: list[str] | None = None) -> DataFrame:
    return flag_gaps(enforce_types(dedupe_latest(sales, order)))


def events_to_daily(events: DataFrame, dedupe_on: list[str] | None = None,
                    order: list[str] | None = None) -> DataFrame:
    """Local events per tenant and day; ``dedupe_on`` drops events published more than once."""
    if dedupe_on:
        events = latest(events, dedupe_on, order or ["ingested_at", "seq"])
    return events.groupBy("user_id", "date").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.coalesce("large_venue", F.lit(False))).alias("large_event_count"),
        F.sort_array(F.collect_set(F.nullif(F.col("category"), F.lit("")))).alias("categories"),
    )


def forward_fill(points: DataFrame, days: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Last observation at or before each requested day, NULL before the first one.

    Every key gets a row per requested day. The spine of a key runs over the span of the requested
    days and is cut to them by a semi join; a key holds at most one row per calendar day.
    """
    days = days.select("date").distinct()
    span = days.agg(F.struct(F.min("date").alias("low"), F.max("date").alias("high")))
    spine = (
        points.select(*keys).distinct()
        .withColumn("_span", span.scalar())
        .select(*keys, F.explode(F.sequence("_span.low", "_span.high", F.expr("interval 1 day"))).alias("date"))
        .join(days, "date", "left_semi")
        .select(*keys, "date", F.lit(None).cast("double").alias(value), F.lit(1).alias("_asked"))
    )
    seen = points.select(*keys, "date", F.col(value).cast("double").alias(value), F.lit(0).alias("_asked"))
    upto = Window.partitionBy(*keys).orderBy("date", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spine.unionByName(seen)
        .withColumn(value, F.last(value, ignorenulls=True).over(upto))
        .filter("_asked = 1").drop("_asked")
    )
