"""Calendar signals per tenant and day: holidays, days to the next holiday, school breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LOOKAHEAD_DAYS = 30


def day_spine(spans: DataFrame) -> DataFrame:
    """One row per tenant and day between ``start_date`` and ``end_date``."""
    return spans.filter("start_date <= end_date").select(
        "user_id", F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("date"))


def holiday_distance(holidays: DataFrame, max_days: int = LOOKAHEAD_DAYS) -> DataFrame:
    """Days to the next holiday for each country and day that has one within ``max_days``.

    Each holiday is written onto the days before it, which turns the as-of search into an equi join.
    """
    return (
        holidays.select("country_code", "date").distinct()
        .select("country_code", "date", F.explode(F.sequence(F.lit(0), F.lit(max_days))).alias("ahead"))
        .select("country_code", F.date_sub("date", F.col("ahead")).alias("date"), "ahead")
        .groupBy("country_code", "date").agg(F.min("ahead").alias("days_to_holiday"))
    )


def holiday_flag(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """``days`` carry country_code and date; adds is_holiday."""
    marks = holidays.select("country_code", "date").distinct().withColumn("is_holiday", F.lit(True))
    return days.join(marks, ["country_code", "date"], "left").withColumn(
        "is_holiday", F.coalesce("is_holiday", F.lit(False)))


def days_to_next(days: DataFrame, holidays: DataFrame, max_days: int = LOOKAHEAD_DAYS) -> DataFrame:
    return days.join(holiday_distance(holidays, max_days), ["country_code", "date"], "left")


def break_days(breaks: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct days inside any inclusive range, cut to the span of the tenant."""
    inside = breaks.join(
        spans.select("user_id", F.col("start_date").alias("_low"), F.col("end_date").alias("_high")), "user_id"
    ).select(
        "user_id", F.greatest("start_date", "_low").alias("start_date"), F.least("end_date", "_high").alias("end_date"))
    return day_spine(inside).distinct()


def in_interval(days: DataFrame, breaks: DataFrame, spans: DataFrame, name: str = "is_school_break") -> DataFrame:
    marks = break_days(breaks, spans).withColumn(name, F.lit(True))
    return days.join(marks, ["user_id", "date"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def calendar_daily(spans: DataFrame, profiles: DataFrame, holidays: DataFrame, breaks: DataFrame) -> DataFrame:
    """Calendar features of every tenant for every day of its span (one row per tenant in ``spans``)."""
    countries = profiles.select(F.col("id").alias("user_id"), "country_code")
    days = day_spine(spans).join(countries, "user_id", "left")
    return in_interval(days_to_next(days, holidays), breaks, spans).select(
        "user_id", "date",
        F.coalesce(F.col("days_to_holiday") == 0, F.lit(False)).alias("is_holiday"),
        "days_to_holiday", "is_school_break",
    )


def tenant_intervals(calendar_events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Calendar ranges of known tenants."""
    tenants = profiles.select(F.col("id").alias("user_id"))
    return calendar_events.join(tenants, "user_id").select("user_id", "label", "start_date", "end_date")
