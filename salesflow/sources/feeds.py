"""Feed responses to daily records: (entity_key, observed_at, payload fields)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesflow.functions.scalars import any_hint, clamp, entity_key, last_of, positive

# Words that mark a large venue, and the missing-value mark of macro series.
LARGE_VENUES = ["stadium", "arena", "festival", "speedway", "raceway"]
MISSING = "."

WEATHER_BODY = (
    "daily struct<time array<string>, temperature_2m_max array<double>, temperature_2m_min array<double>, "
    "temperature_2m_mean array<double>, precipitation_sum array<double>, snowfall_sum array<double>, "
    "weather_code array<int>>")
HOLIDAY_BODY = "array<struct<date string, localName string, name string, global boolean, counties array<string>>>"
TRENDS_BODY = "map<string, array<struct<day string, interest int>>>"
MACRO_BODY = "observations array<struct<date string, value string>>"
EVENTS_BODY = (
    "_embedded struct<events array<struct<id string, name string, dates struct<start struct<localDate string>>, "
    "classifications array<struct<segment struct<name string>>>, _embedded struct<venues array<struct<name string>>>>>>")
MARKET_BODY = "products array<struct<asin string, title string, csv array<array<int>>>>"


def parse_weather(df: DataFrame, body: str = "body") -> DataFrame:
    """Daily columns of a response as rows; short or missing columns give NULL."""
    days = df.withColumn("_b", F.from_json(body, WEATHER_BODY)).select(
        "user_id", "_b.daily", F.posexplode("_b.daily.time").alias("_i", "_day"))
    at = lambda name: F.get(F.col(f"daily.{name}"), F.col("_i"))
    return days.select(
        F.col("user_id").alias("entity_key"), F.try_to_date("_day").alias("observed_at"), "user_id",
        at("temperature_2m_max").alias("temp_max"), at("temperature_2m_min").alias("temp_min"),
        at("temperature_2m_mean").alias("temp_avg"), at("precipitation_sum").alias("precip_mm"),
        at("snowfall_sum").alias("snowfall_mm"), at("weather_code").alias("weather_code"))


def parse_holidays(df: DataFrame, body: str = "body") -> DataFrame:
    """Dated holidays of a country; nationwide unless stated, no counties by default."""
    items = df.select("country_code", F.explode(F.from_json(body, HOLIDAY_BODY)).alias("h")).filter("h.date <> ''")
    return items.select(
        entity_key(F.col("country_code"), F.col("h.date")).alias("entity_key"),
        F.try_to_date("h.date").alias("observed_at"), "country_code", F.col("h.localName").alias("local_name"),
        "h.name", F.coalesce("h.global", F.lit(True)).alias("global"),
        F.coalesce("h.counties", F.array().cast("array<string>")).alias("counties"))


def parse_trends(df: DataFrame, body: str = "body") -> DataFrame:
    """Interest per keyword and day, held within 0..100."""
    words = df.select("user_id", "category", F.explode(F.from_json(body, TRENDS_BODY)).alias("keyword", "_points"))
    points = words.select("user_id", "category", "keyword", F.explode("_points").alias("p"))
    return points.select(
        entity_key(F.col("user_id"), F.col("category"), F.col("keyword")).alias("entity_key"),
        F.try_to_date("p.day").alias("observed_at"), "user_id", "category", "keyword",
        clamp(F.col("p.interest").cast("double"), 0, 100).alias("interest"))


def parse_macro(df: DataFrame, body: str = "body") -> DataFrame:
    """Observations with a numeric value."""
    items = df.select("series", F.explode(F.from_json(body, MACRO_BODY)["observations"]).alias("o"))
    value = F.when(F.col("o.value") != MISSING, F.col("o.value").try_cast("double"))
    return items.select(
        entity_key(F.col("series"), F.col("o.date")).alias("entity_key"), F.try_to_date("o.date").alias("observed_at"),
        "series", value.alias("value")).filter("value is not null")


def venue_names(event: Column) -> Column:
    return F.array_join(F.transform(event["_embedded"]["venues"], lambda v: F.coalesce(v["name"], F.lit(""))), " ")


def parse_events(df: DataFrame, body: str = "body") -> DataFrame:
    """Dated local events with category and venue size."""
    items = df.select("user_id", F.explode(F.from_json(body, EVENTS_BODY)["_embedded"]["events"]).alias("e"))
    e, day = F.col("e"), F.col("e.dates.start.localDate")
    segment = F.get(e["classifications"], F.lit(0))["segment"]["name"]
    return items.filter(day != "").select(
        entity_key(F.col("user_id"), F.coalesce(e["id"], day)).alias("entity_key"),
        F.try_to_date(day).alias("observed_at"), "user_id", e["id"].alias("event_id"), e["name"].alias("name"),
        F.coalesce(segment, F.lit("Other")).alias("category"), any_hint(venue_names(e), LARGE_VENUES).alias("large_venue"))


def parse_marketplace(df: DataFrame, today: Column, body: str = "body") -> DataFrame:
    """Last price (minor units in the response) and last rank of each product."""
    items = df.select("user_id", F.explode(F.from_json(body, MARKET_BODY)["products"]).alias("p")).filter("p.asin <> ''")
    last = lambda i: positive(last_of(F.get(F.col("p.csv"), F.lit(i))))
    return items.select(
        entity_key(F.col("user_id"), F.col("p.asin")).alias("entity_key"), today.alias("observed_at"), "user_id",
        "p.asin", (last(0) / 100).alias("price"), last(3).cast("bigint").alias("bsr"), "p.title")
