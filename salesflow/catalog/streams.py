"""Queries: streaming forms run to the end of the given tables, the boosted model and the nightly run."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesflow.catalog.features import gold, rounded
from salesflow.catalog.registry import query
from salesflow.catalog.validation import CHECKED, MAX_ROWS, MAX_SKUS, checked_views
from salesflow.plans import forecast, model, nightly, selection
from salesflow.schemas import PAYLOADS, SERIES
from salesflow.session import materialize, scratch_path
from salesflow.sources.envelopes import to_envelope
from salesflow.sources.sample_tables import SALES_ORDER, TABLES
from salesflow.streaming import streams
from salesflow.streaming.views import versions


def event_stream(s):
    """The events table as a stream of local events; the pattern finds a single file as well as a folder."""
    raw = s.spark.readStream.schema(TABLES["events"]).parquet(f"{s.folder}/event[s].parquet").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select("event_id", "ts", F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("user_id"),
                      "event_type", (k >= 80).alias("large_venue"), k.alias("k"), "value")


def finished(s, started):
    started.awaitTermination()
    return started


@query("stream_events_daily", """
    SELECT concat('r', user_id % 5) AS user_id, CAST(ts AS DATE) AS date, count(*) AS event_count,
           count(*) FILTER (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) >= 80) AS large_event_count
    FROM events WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def _(s):
    """Days that the watermark has closed."""
    out = scratch_path(s.spark, "stream-days")
    finished(s, streams.run_available(streams.stream_events_daily(event_stream(s)), f"{out}/rows", f"{out}/state"))
    return s.spark.read.schema("user_id string, date date, event_count bigint, large_event_count bigint").parquet(f"{out}/rows")


@query("stream_events_daily_all", """
    SELECT concat('r', user_id % 5) AS user_id, CAST(ts AS DATE) AS date, count(*) AS event_count,
           count(*) FILTER (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) >= 80) AS large_event_count
    FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def _(s):
    """All days, also those still open."""
    out = scratch_path(s.spark, "stream-all-days")
    finished(s, streams.stream_daily_counts(event_stream(s), f"{out}/rows", f"{out}/state"))
    days = s.spark.read.schema("user_id string, event_count bigint, large_event_count bigint, date date").parquet(f"{out}/rows")
    return days.select("user_id", "date", "event_count", "large_event_count")


@query("stream_dedupe", "SELECT event_id, event_type, value FROM events")
def _(s):
    """Every event arrives twice; one copy stays."""
    out = scratch_path(s.spark, "stream-dedupe")
    twice = event_stream(s).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    once = streams.stream_dedupe(twice, ["event_id"], "ts").select("event_id", "event_type", "value")
    finished(s, streams.run_available(once, f"{out}/rows", f"{out}/state"))
    return s.spark.read.schema("event_id bigint, event_type string, value double").parquet(f"{out}/rows")


@query("stream_versions", "SELECT event_id, event_type, value + 1 AS value, ts + INTERVAL 10 DAY AS sent FROM events")
def _(s):
    """Every event comes again ten days later with a newer value, and once more with an older one; the newest stays."""
    out = scratch_path(s.spark, "stream-versions")
    rows = s.table("events").select("event_id", "event_type", "value", F.col("ts").alias("sent"))
    later = rows.withColumns({"sent": F.col("sent") + F.expr("interval 10 days"), "value": F.col("value") + 1})
    older = rows.withColumns({"sent": F.col("sent") - F.expr("interval 1 day"), "value": F.col("value") - 1})
    for copies in (rows, later.unionByName(older)):
        copies.write.mode("append").parquet(f"{out}/in")
        arriving = s.spark.readStream.schema(rows.schema).parquet(f"{out}/in")
        finished(s, streams.stream_versions(arriving, f"{out}/store", f"{out}/state", ["event_id"], ["sent"]))
    return versions(s.spark, f"{out}/store", "event_id bigint, event_type string, value double, sent timestamp_ntz")


@query("stream_bronze", """
    SELECT concat('r', user_id % 5, ':', event_id) AS entity_key, CAST(ts AS DATE) AS observed_at, CAST(1 AS INTEGER) AS schema_version,
           concat('r', user_id % 5) AS user_id, value FROM events""")
def _(s):
    out = scratch_path(s.spark, "stream-bronze")
    rows = event_stream(s).withColumn("day", F.to_date("ts"))
    messages = to_envelope(rows, "events", ["user_id", "event_id"], ["user_id", "value"], "day", F.col("ts"))
    finished(s, streams.stream_bronze(messages, f"{out}/rows", f"{out}/state"))
    bronze = s.spark.read.parquet(f"{out}/rows")
    body = F.from_json("payload", "user_id string, value double")
    return bronze.select("entity_key", "observed_at", "schema_version", body.alias("p")).select("entity_key", "observed_at", "schema_version", "p.*")


@query("stream_health", """
    SELECT signal, status, last_error FROM (SELECT event_type AS signal,
           CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) < 10 THEN 'stale' ELSE 'live' END AS status,
           concat('e', event_id) AS last_error, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM events)
    WHERE rn = 1""")
def _(s):
    out = scratch_path(s.spark, "stream-health")
    reports = event_stream(s).select(
        F.col("event_type").alias("signal"), F.when(F.col("k") < 10, "stale").otherwise("live").alias("status"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("last_error"), F.col("ts").alias("reported_at"))
    finished(s, streams.stream_health(reports, f"{out}/rows", f"{out}/state"))
    return s.spark.read.parquet(f"{out}/rows").select(F.col("signal").cast("string").alias("signal"), "status", "last_error")


@query("sales_event_stream", """
    SELECT concat(user_id, ':', sku) AS key, upload_id, CAST(date AS DATE) AS date, CAST(quantity AS DOUBLE) AS quantity,
           TRY_CAST(revenue AS DOUBLE) AS revenue, TRY_CAST(price AS DOUBLE) AS price,
           promo_flag IN ('true', '1', 'yes') AS promo_flag FROM checked WHERE field IS NULL""", checked_views(10 ** 9, 10 ** 9))
def _(s):
    """Upload rows arrive as files and leave as messages; read back from their payload."""
    out = scratch_path(s.spark, "stream-sales")
    rows = s.upload_rows()
    rows.write.option("compression", "gzip").json(f"{out}/in")
    arriving = s.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).json(f"{out}/in")
    finished(s, streams.stream_sales_events(arriving, f"{out}/rows", f"{out}/state", s.as_of().cast("timestamp")))
    sent = s.spark.read.json(f"{out}/rows")
    body = F.from_json(F.get_json_object("value", "$.payload"), PAYLOADS["sales_csv"])
    return sent.select("key", body.alias("p")).select("key", "p.upload_id", "p.date", "p.quantity", "p.revenue", "p.price", "p.promo_flag")


@query("sales_event_errors", f"""
    SELECT upload_id, CAST(row_no AS INTEGER) AS row, field, message FROM checked WHERE field IS NOT NULL AND row_no - 1 <= {MAX_ROWS}
    UNION ALL SELECT upload_id, row, field, message FROM beyond""", CHECKED)
def _(s):
    """Uploads that arrive in two parts: the limits of an upload hold for the whole of it."""
    out = scratch_path(s.spark, "stream-parts")
    rows = s.stored("upload_rows", lambda: s.upload_rows().drop("seq"))
    for part in (F.col("row_no") <= 4, F.col("row_no") > 4):
        rows.filter(part).write.mode("append").parquet(f"{out}/in")
        arriving = s.spark.readStream.schema(rows.schema).parquet(f"{out}/in")
        finished(s, streams.stream_sales_events(arriving, f"{out}/rows", f"{out}/state", s.as_of().cast("timestamp"), MAX_ROWS, MAX_SKUS, f"{out}/errors"))
    return s.spark.read.schema("upload_id string, row int, field string, message string").parquet(f"{out}/errors").drop("batch")


def ranked_gold(s):
    rows = gold(s)
    extra = [c for c in rows.columns if c not in (*SERIES, "date", "quantity")]
    return materialize(selection.split_holdout(rows, extra=extra).drop("holdout"), "ranked")


@query("quantile_forecast")
def _(s):
    """Boosted median and the band of each row on the holdout of every series."""
    ranked = ranked_gold(s)
    fitted = model.fit_quantiles(ranked.filter("back > 60"))
    return fitted.predict(ranked.filter("back <= 60")).select(
        *SERIES, "date", "quantity", "yhat", "yhat_lower", "yhat_upper")


@query("feature_importance")
def _(s):
    """Share of each feature in the loss that the fitted trees' splits take from the rows of each series."""
    ranked = ranked_gold(s)
    return model.series_importances(ranked, model.fit_quantiles(ranked))


@query("recursive_forecast")
def _(s):
    from salesflow.catalog.forecasting import start

    rows = materialize(gold(s), "gold")
    fitted = model.fit_quantiles(rows)
    context = forecast.future_context(*[d for d in _future(s)], start(s), 30)
    return model.recursive_forecast(fitted, rows.select(*SERIES, "date", "quantity"), context, start(s), 30)


def _future(s):
    from salesflow.operators import calendar

    return (calendar.calendar_daily(s.spans(30), s.profiles(), s.holidays(), s.calendar_events()),
            s.weather(), s.events_daily(), s.trends())


def nightly_inputs(s):
    return nightly.Inputs(
        sales=s.sales_newest(), profiles=s.profiles(), holidays=s.holidays(),
        breaks=s.calendar_events(), weather=s.weather_raw(), trends=s.trends_raw(), events=s.events_raw(),
        sales_order=SALES_ORDER, signal_order=["ingested_at", "seq"])


@query("nightly_run")
def _(s):
    """The published forecasts of one nightly run over all tenants."""
    return nightly.run(nightly_inputs(s), s.as_of()).forecasts
