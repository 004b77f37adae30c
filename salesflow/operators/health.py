"""Feed health: status by age, latest report, replay of last known rows, run reports, gating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesflow.functions.scalars import clean, seconds
from salesflow.operators.keyed import latest
from salesflow.schemas import FEED_LIMITS, OFF_BY_DEFAULT, SIGNALS

HOUR = 3600.0


def limit_hours(source: Column, which: int) -> Column:
    """Freshness (0) or replay (1) limit of a feed in hours; twelve hours and seven days for others."""
    pairs = [F.lit(x) for feed, hours in FEED_LIMITS.items() for x in (feed, hours[which])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit((12, 7 * 24)[which]))


def status_of(last_success: Column, freshness_hours: Column, ttl_hours: Column, now: Column) -> Column:
    age = seconds(now) - seconds(last_success)
    return (
        F.when(last_success.isNull(), "degraded").when(age <= freshness_hours * HOUR, "live")
        .when(age <= (freshness_hours + ttl_hours) * HOUR, "stale").otherwise("degraded"))


def health_status(runs: DataFrame, now: Column, source: str = "source") -> DataFrame:
    """Adds ``status`` from ``last_success_at``."""
    feed = F.col(source)
    return runs.withColumn("status", status_of(
        F.col("last_success_at"), limit_hours(feed, 0), limit_hours(feed, 1), now))


def latest_health(messages: DataFrame, payload: str = "value", order: list[str] | None = None) -> DataFrame:
    """Newest report per signal from JSON health messages, with or without an envelope around them."""
    order = order or ["reported_at", "seq"]
    inner = F.coalesce(F.get_json_object(payload, "$.payload"), F.col(payload))
    names = ["source", "signal", "status", "last_success_at", "error"]
    fields = messages.select(F.json_tuple(inner, *names).alias(*[f"_{n}" for n in names]), *order)
    reports = fields.select(
        F.coalesce("_source", "_signal").alias("signal"), F.coalesce("_status", F.lit("degraded")).alias("status"),
        F.col("_last_success_at").try_cast("timestamp").alias("last_success_at"), F.col("_error").alias("last_error"), *order)
    newest = latest(reports.filter("signal is not null"), ["signal"], order)
    return newest.select("signal", "status", "last_success_at", "last_error")


STALE_MARK = r"""(?:,\s*"stale"\s*:\s*true(?=\s*\}\s*$))|(?:(?<=^\{)\s*"stale"\s*:\s*true\s*(?=\}\s*$))"""


def stale_stamp(df: DataFrame) -> DataFrame:
    """Mark replayed rows; a JSON payload gets the mark inside, once however often it is replayed."""
    if "payload" in df.columns:
        stamped = F.regexp_replace(F.regexp_replace("payload", STALE_MARK, ""), r"\}\s*$", "")
        comma = F.when(stamped.rlike(r"^\s*\{\s*$"), F.lit("")).otherwise(F.lit(","))
        return df.withColumn("payload", F.concat(stamped, comma, F.lit('"stale":true}')))
    return df.withColumn("stale", F.lit(True))


def stale_fallback(events: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Rows to replay: of each feed whose newest run failed, those of its newest good run that published any, within the limit.

    ``runs``: source, run_id, ran_at, ok. ``events`` carry source and run_id; replayed rows are ingested ``now``.
    """
    newest = latest(runs.select("source", "ran_at", "run_id", "ok"), ["source"], ["ran_at", "run_id"])
    failed = newest.filter("not ok").select("source")
    published = events.select("source", "run_id").distinct()
    full = runs.filter("ok").select("source", "ran_at", "run_id").join(published, ["source", "run_id"], "left_semi")
    good = latest(full, ["source"], ["ran_at", "run_id"])
    age = seconds(now) - seconds(F.col("ran_at"))
    replay = good.filter(age <= limit_hours(F.col("source"), 1) * HOUR).join(failed, "source", "left_semi")
    rows = events.join(replay.select("source", "run_id"), ["source", "run_id"], "left_semi")
    if "ingested_at" in rows.columns:
        rows = rows.withColumn("ingested_at", now.cast(rows.schema["ingested_at"].dataType))
    return stale_stamp(rows)


def run_report(runs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Per feed run: published rows, whether they came from the last good run, status and error."""
    published = events.groupBy("source", "run_id").agg(
        F.count(F.lit(1)).alias("published"), F.bool_or(F.coalesce("stale", F.lit(False))).alias("from_cache"))
    rows = health_status(runs, now).join(published, ["source", "run_id"], "left")
    cached = F.coalesce("from_cache", F.lit(False))
    status = F.when(F.col("ok"), "live").when(cached & (F.col("status") == "degraded"), "stale").otherwise(F.col("status"))
    return rows.select("source", "run_id", F.coalesce("published", F.lit(0)).alias("published"),
                       cached.alias("from_cache"), status.alias("status"), "error")


def enabled_signals(settings: DataFrame, per_tenant: bool = False) -> DataFrame:
    """Toggles that are on, over all tenants or per tenant."""
    return settings.filter("enabled").select(*(["user_id"] if per_tenant else []), "signal").distinct()


def country_codes(profiles: DataFrame) -> DataFrame:
    return profiles.select("country_code").filter("country_code <> ''").distinct().orderBy("country_code")


def category_keywords(products: DataFrame) -> DataFrame:
    """The search keyword of each tenant and category: the trimmed category itself."""
    keyed = products.select("user_id", clean(F.col("category")).alias("category")).filter("category <> ''").distinct()
    return keyed.withColumn("keyword", F.col("category"))


def seed_settings(tenants: DataFrame, settings: DataFrame) -> DataFrame:
    """Existing toggles plus the defaults of those a tenant has not set."""
    defaults = tenants.select("user_id", F.explode(F.array(*[F.lit(s) for s in SIGNALS])).alias("signal")).join(
        settings.select("user_id", "signal"), ["user_id", "signal"], "left_anti")
    return settings.select("user_id", "signal", "enabled").unionByName(
        defaults.withColumn("enabled", ~F.col("signal").isin(OFF_BY_DEFAULT)))


def signal_gating(settings: DataFrame, profiles: DataFrame, products: DataFrame, asins: DataFrame) -> DataFrame:
    """Feeds that run: switched on by some tenant and with the configuration they need."""
    some = lambda df: df.agg(F.count(F.lit(1)) > 0).scalar()
    located = some(profiles.filter("latitude is not null and longitude is not null"))
    needs = {
        "weather": located, "events": located, "holidays": some(country_codes(profiles)),
        "trends": some(products.filter(clean(F.col("category")) != "")), "marketplace": some(asins), "macro": F.lit(True),
    }
    feed = F.col("signal")
    ready = F.coalesce(*[F.when(feed == name, need) for name, need in needs.items()], F.lit(False))
    on = enabled_signals(settings).withColumn("_on", F.lit(True))
    toggles = settings.select("signal").distinct().join(on, "signal", "left")
    return toggles.select("signal", F.coalesce("_on", F.lit(False)).alias("enabled"),
                          (F.coalesce("_on", F.lit(False)) & ready).alias("runs"))


def producer_config(profiles: DataFrame, settings: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """What the feeds need to run, one table per part."""
    return {
        "enabled_signals": enabled_signals(settings),
        "locations": profiles.filter("latitude is not null and longitude is not null").select(
            F.col("id").alias("user_id"), "latitude", "longitude",
            F.coalesce(F.nullif(F.col("timezone"), F.lit("")), F.lit("UTC")).alias("timezone")),
        "country_codes": country_codes(profiles),
        "category_keywords": category_keywords(products),
        "geo_by_user": profiles.select(
            F.col("id").alias("user_id"), F.coalesce("country_code", F.lit("")).alias("country_code")),
    }
