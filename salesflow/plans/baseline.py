"""Seasonal-naive baseline in closed form: one pass over each series, no recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from salesflow.functions.scalars import clamp
from salesflow.schemas import SERIES

Z_80 = 1.2816  # fixed value: two-sided 80 % band
WEEK = 7
TAIL_ROWS = 28


def newest_first(daily: DataFrame, *extra: str) -> DataFrame:
    """Adds ``back`` (1 = newest row) and the quantity of seven rows earlier."""
    window = Window.partitionBy(*SERIES).orderBy(F.desc("date"))
    return daily.select(
        *SERIES, "date", "quantity", *extra,
        F.row_number().over(window).alias("back"), F.lead("quantity", WEEK).over(window).alias("_week_ago"),
    )


def history_columns(skip: int = 0) -> list[Column]:
    """Aggregates of one series, leaving out its newest ``skip`` rows.

    rows, tail_mean, sigma and the last week in date order (at most seven values).
    """
    back = F.col("back") - skip
    known = back > 0
    diff = F.when(known, F.col("quantity") - F.col("_week_ago"))
    tail = F.coalesce(F.avg(F.when(known & (back <= TAIL_ROWS), F.col("quantity"))), F.lit(0.0))
    week = F.collect_list(F.when(known & (back <= WEEK), F.struct(back.alias("back"), F.col("quantity").alias("q"))))
    return [
        F.count_if(known).alias("rows"),
        tail.alias("tail_mean"),
        F.coalesce(F.sqrt(F.avg(diff * diff)), F.greatest(tail * 0.2, F.lit(1.0))).alias("sigma"),
        F.transform(F.sort_array(week, asc=False), lambda x: x["q"]).alias("last_week"),
    ]


def history_stats(daily: DataFrame, skip: int = 0) -> DataFrame:
    return newest_first(daily).groupBy(*SERIES).agg(*history_columns(skip))


def tail_mean(daily: DataFrame) -> DataFrame:
    return history_stats(daily).select(*SERIES, "tail_mean")


def weekly_sigma(daily: DataFrame) -> DataFrame:
    return history_stats(daily).select(*SERIES, "sigma")


def naive_value(step: Column) -> Column:
    """Unclamped value of a step from rows, tail_mean and last_week.

    A week or more of history repeats its last seven rows. A shorter history is first padded to a
    week with the tail mean, and the forecast starts behind the known rows.
    """
    short = F.col("rows") < WEEK
    cycle = F.concat("last_week", F.array_repeat("tail_mean", (WEEK - F.size("last_week")).cast("int")))
    at = F.pmod(F.when(short, F.col("rows")).otherwise(F.lit(0)) + step - 1, F.lit(WEEK))
    return F.get(cycle, at.cast("int"))


def band(value: Column, step: Column) -> dict[str, Column]:
    spread = F.lit(Z_80) * F.col("sigma") * F.sqrt(step)
    return {"yhat": clamp(value, 0), "yhat_lower": clamp(value - spread, 0), "yhat_upper": value + spread}


def points(stats: DataFrame, start: Column, horizon: int) -> DataFrame:
    """Forecast rows from history statistics; further columns of ``stats`` are dropped."""
    steps = stats.withColumn("_start", start).select(
        *SERIES, "rows", "tail_mean", "sigma", "last_week", "_start",
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    steps = steps.withColumn("_value", naive_value(F.col("step")))
    return steps.withColumns(band(F.col("_value"), F.col("step"))).select(
        *SERIES, F.date_add("_start", F.col("step") - 1).alias("date"), "yhat", "yhat_lower", "yhat_upper")


def seasonal_naive(daily: DataFrame, start: Column, horizon: int = 30) -> DataFrame:
    """``horizon`` days per series from ``start`` on."""
    return points(history_stats(daily), start, horizon)
