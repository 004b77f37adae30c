"""Queries: envelopes, feed responses, feed health and generated sales.

Feed responses are put together from the events table, a few rows per response, and parsed again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from salesflow.catalog.registry import query
from salesflow.operators import health
from salesflow.session import scratch_path
from salesflow.sources import envelopes, feeds
from salesflow.sources.layers import append_bronze

ROWS_PER_BODY = 20

BODIES = {
    "body_rows": f"""
        SELECT *, seq // {ROWS_PER_BODY} AS body,
               row_number() OVER (PARTITION BY user_id, seq // {ROWS_PER_BODY} ORDER BY seq) AS rn FROM signals"""}


def collected(rows, keys, **items):
    """One row per response: arrays of at most ROWS_PER_BODY values in event order."""
    bucket = F.floor(F.col("seq") / ROWS_PER_BODY).alias("body_no")
    grouped = rows.groupBy(*keys, bucket).agg(
        F.sort_array(F.collect_list(F.struct("seq", *[v.alias(k) for k, v in items.items()]))).alias("_rows"))
    return grouped.select(*keys, "body_no", *[F.col(f"_rows.{k}").alias(k) for k in items])


@query("weather_parse", """
    SELECT user_id AS entity_key, date AS observed_at, user_id, value AS temp_max,
           CAST(NULL AS DOUBLE) AS temp_min, value / 2 AS temp_avg,
           CASE WHEN rn <= 2 THEN CAST(k AS DOUBLE) END AS precip_mm, CAST(NULL AS DOUBLE) AS snowfall_mm, k AS weather_code
    FROM body_rows""", BODIES)
def _(s):
    """Rain has two values per response only; minimum and snow are absent."""
    b = collected(s.signals(), ["user_id"], day=F.col("date").cast("string"), high=F.col("value"),
                  mean=F.col("value") / 2, rain=F.col("k").cast("double"), code=F.col("k"))
    daily = F.struct(
        F.col("day").alias("time"), F.col("high").alias("temperature_2m_max"), F.col("mean").alias("temperature_2m_mean"),
        F.slice("rain", 1, 2).alias("precipitation_sum"), F.col("code").alias("weather_code"))
    return feeds.parse_weather(b.select("user_id", F.to_json(F.struct(daily.alias("daily"))).alias("body")))


@query("holidays_parse", """
    SELECT concat(country_code, ':', CAST(date AS VARCHAR)) AS entity_key, date AS observed_at, country_code,
           concat('l', k) AS local_name, concat('n', k) AS name, CASE WHEN k % 3 = 1 THEN false ELSE true END AS global,
           CASE WHEN k % 4 = 0 THEN concat('US-', k) ELSE '' END AS counties
    FROM signals WHERE k % 10 <> 0""")
def _(s):
    k = F.col("k")
    item = F.struct(
        F.when(k % 10 != 0, F.col("date").cast("string")).alias("date"), F.concat(F.lit("l"), k).alias("localName"),
        F.concat(F.lit("n"), k).alias("name"), F.when(k % 3 != 0, k % 3 == 2).alias("global"),
        F.when(k % 4 == 0, F.array(F.concat(F.lit("US-"), k))).alias("counties"))
    b = collected(s.signals(), ["country_code"], item=item)
    rows = feeds.parse_holidays(b.select("country_code", F.to_json("item").alias("body")))
    return rows.withColumn("counties", F.array_join("counties", ","))


@query("trends_parse", """
    SELECT concat(user_id, ':kitchen:', 'kw', k % 3) AS entity_key, date AS observed_at, user_id, 'kitchen' AS category,
           concat('kw', k % 3) AS keyword, CAST(greatest(0, least(100, k * 2 - 20)) AS DOUBLE) AS interest FROM signals""")
def _(s):
    point = F.struct(F.col("date").cast("string").alias("day"), (F.col("k") * 2 - 20).alias("interest"))
    words = s.signals().withColumn("keyword", F.concat(F.lit("kw"), (F.col("k") % 3).cast("string")))
    lists = collected(words, ["user_id", "keyword"], points=point)
    bodies = lists.groupBy("user_id", "body_no").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("keyword", "points")))).alias("body"))
    return feeds.parse_trends(bodies.withColumn("category", F.lit("kitchen")))


@query("macro_parse", """
    SELECT concat('S', user_id, ':', CAST(date AS VARCHAR)) AS entity_key, date AS observed_at, concat('S', user_id) AS series,
           value FROM signals WHERE k % 6 > 1""")
def _(s):
    text = F.when(F.col("k") % 6 == 0, ".").when(F.col("k") % 6 == 1, "n/a").otherwise(F.col("value").cast("string"))
    item = F.struct(F.col("date").cast("string").alias("date"), text.alias("value"))
    b = collected(s.signals().withColumn("series", F.concat(F.lit("S"), "user_id")), ["series"], observations=item)
    return feeds.parse_macro(b.select("series", F.to_json(F.struct("observations")).alias("body")))


@query("events_parse", """
    SELECT concat(user_id, ':e', seq) AS entity_key, date AS observed_at, user_id, concat('e', seq) AS event_id,
           concat('show ', k) AS name, CASE WHEN k % 5 = 0 THEN 'Other' ELSE concat('cat', k % 5) END AS category,
           k >= 80 AS large_venue FROM signals WHERE k % 7 <> 0""")
def _(s):
    k = F.col("k")
    venues = F.array(F.struct(F.lit("Club").alias("name")),
                     F.struct(F.when(k >= 80, "City ARENA").otherwise("Hall").alias("name")))
    segment = F.struct(F.struct(F.concat(F.lit("cat"), (k % 5).cast("string")).alias("name")).alias("segment"))
    item = F.struct(
        F.concat(F.lit("e"), F.col("seq").cast("string")).alias("id"), F.concat(F.lit("show "), k.cast("string")).alias("name"),
        F.struct(F.struct(F.when(k % 7 != 0, F.col("date").cast("string")).alias("localDate")).alias("start")).alias("dates"),
        F.when(k % 5 != 0, F.array(segment)).alias("classifications"), F.struct(venues.alias("venues")).alias("_embedded"))
    b = collected(s.signals(), ["user_id"], events=item)
    return feeds.parse_events(b.select("user_id", F.to_json(F.struct(F.struct("events").alias("_embedded"))).alias("body")))


@query("marketplace_parse", """
    SELECT concat(user_id, ':B', lpad(CAST(seq AS VARCHAR), 9, '0')) AS entity_key, (SELECT d FROM as_of) AS observed_at,
           user_id, concat('B', lpad(CAST(seq AS VARCHAR), 9, '0')) AS asin,
           CASE WHEN k % 4 <> 0 AND k % 5 <> 0 THEN CAST(k AS DOUBLE) / 100 END AS price, CAST(seq + 1 AS BIGINT) AS bsr,
           concat('t', k) AS title FROM signals WHERE k % 9 <> 0""")
def _(s):
    k, none = F.col("k"), F.lit(None).cast("array<int>")
    prices = F.when(k % 4 == 0, F.array(k)).otherwise(F.array(F.lit(7), F.when(k % 5 == 0, -1).otherwise(k)))
    ranks = F.array(F.lit(7), F.lit(8), F.lit(9), (F.col("seq") + 1).cast("int"))
    item = F.struct(
        F.when(k % 9 != 0, F.concat(F.lit("B"), F.lpad(F.col("seq").cast("string"), 9, "0"))).alias("asin"),
        F.concat(F.lit("t"), k.cast("string")).alias("title"), F.array(prices, none, none, ranks).alias("csv"))
    b = collected(s.signals(), ["user_id"], products=item)
    return feeds.parse_marketplace(b.select("user_id", F.to_json(F.struct("products")).alias("body")), s.as_of())


def weather_messages(s):
    """Weather rows as envelope messages."""
    rows = s.signals().withColumn("temp_avg", F.col("value")).withColumn("precip_mm", F.col("k").cast("double"))
    return envelopes.to_envelope(rows, "weather", ["user_id"], ["user_id", "temp_avg", "precip_mm"], "date",
                                 F.date_trunc("second", F.col("ingested_at").cast("timestamp")))


@query("envelope_emit", """
    SELECT user_id AS key, concat('{"source":"weather","entity_key":"', user_id, '","observed_at":"', CAST(date AS VARCHAR),
           '","ingested_at":"', strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ'), '","schema_version":1,"payload":{"user_id":"', user_id,
           '","precip_mm":', k, '.0}}') AS value FROM signals""")
def _(s):
    rows = s.signals().withColumn("precip_mm", F.col("k").cast("double"))
    return envelopes.to_envelope(rows, "weather", ["user_id"], ["user_id", "precip_mm"], "date",
                                 F.col("ingested_at").cast("timestamp"))


@query("envelope_parse", """
    SELECT 'weather' AS source, user_id AS entity_key, date AS observed_at, date_trunc('second', ingested_at) AS ingested_at,
           CAST(1 AS INTEGER) AS schema_version, user_id, value AS temp_avg, CAST(k AS DOUBLE) AS precip_mm FROM signals""")
def _(s):
    """The envelope's fields, and those of its payload as it arrives."""
    rows = envelopes.parse_envelope(weather_messages(s))
    body = F.from_json("payload", "user_id string, temp_avg double, precip_mm double")
    return rows.withColumns({"ingested_at": F.col("ingested_at").cast("timestamp_ntz"), "p": body}).select(
        "source", "entity_key", "observed_at", "ingested_at", "schema_version", "p.*")


@query("payload_explode", """
    SELECT user_id, value AS temp_avg, CAST(k AS DOUBLE) AS precip_mm, date, date_trunc('second', ingested_at) AS ingested_at
    FROM signals""")
def _(s):
    rows = envelopes.payloads(envelopes.parse_envelope(weather_messages(s)), "weather")
    return rows.select("user_id", "temp_avg", "precip_mm", "date", F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"))


@query("signal_split", """
    SELECT source, date, CASE source WHEN 'holidays' THEN country_code WHEN 'macro' THEN concat('S', k % 4) ELSE user_id END AS entity,
           CASE source WHEN 'weather' THEN value WHEN 'macro' THEN value WHEN 'trends' THEN CAST(k AS DOUBLE) END AS value FROM signals""")
def _(s):
    """All sources in one envelope table, split into typed tables, shown side by side."""
    payload = F.to_json(F.struct(
        "user_id", "country_code", F.concat(F.lit("S"), (F.col("k") % 4).cast("string")).alias("series"), "value",
        F.col("value").alias("temp_avg"), F.col("k").alias("interest")))
    rows = s.signals().select("source", F.col("date").alias("observed_at"), "ingested_at", payload.alias("payload"))
    path = scratch_path(s.spark, "bronze")
    append_bronze(rows.withColumn("observed_at", F.col("observed_at").cast("date")), path, "ingested_at")
    parts = envelopes.split_signals(s.spark.read.schema(rows.schema).parquet(path))
    shown = [("weather", "user_id", "temp_avg"), ("trends", "user_id", "interest"), ("holidays", "country_code", None),
             ("events", "user_id", None), ("macro", "series", "value")]
    out = None
    for source, entity, value in shown:
        number = F.col(value) if value else F.lit(None).cast("double")
        part = parts[source].select(F.lit(source).alias("source"), "date", F.col(entity).alias("entity"), number.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("route_publish", """
    SELECT source AS source, concat(user_id, ':', seq) AS entity_key, date AS observed_at, false AS health FROM signals WHERE k >= 10
    UNION ALL SELECT source, user_id, NULL, true FROM signals WHERE k < 10""")
def _(s):
    body = F.struct("source", F.concat_ws(":", "user_id", "seq").alias("entity_key"),
                    F.when(F.col("k") >= 10, F.col("date").cast("string")).alias("observed_at"), F.struct("k").alias("payload"))
    messages = s.signals().select(
        F.when(F.col("k") < 10, envelopes.HEALTH_TOPIC).otherwise(F.concat(F.lit("signals."), "source")).alias("topic"),
        F.col("user_id").alias("key"), F.to_json(body).alias("value"))
    events, reports = envelopes.route(messages)
    return events.select("source", "entity_key", "observed_at", F.lit(False).alias("health")).unionByName(reports.select(
        F.get_json_object("value", "$.source").alias("source"), F.col("key").alias("entity_key"),
        F.lit(None).cast("date").alias("observed_at"), F.lit(True).alias("health")))


@query("latest_health", """
    SELECT signal, CASE WHEN status = 'live' THEN status ELSE 'degraded' END AS status, last_error FROM signal_status""")
def _(s):
    """Every second message comes without an envelope; only live reports name a status."""
    report = F.struct(
        F.when(F.col("seq") % 3 > 0, F.col("signal")).alias("source"), F.col("signal"),
        F.when(F.col("status") == "live", F.col("status")).alias("status"), F.col("last_error").alias("error"))
    value = F.when(F.col("seq") % 2 == 0, F.to_json(F.struct(report.alias("payload")))).otherwise(F.to_json(report))
    messages = s.health_reports().select(value.alias("value"), "reported_at", "seq")
    return health.latest_health(messages).drop("last_success_at")


@query("health_status", """
    SELECT seq, source, CASE WHEN k % 10 = 0 THEN 'degraded' WHEN k * 5 <= f THEN 'live' WHEN k * 5 <= f + t THEN 'stale'
           ELSE 'degraded' END AS status
    FROM (SELECT *, CASE source WHEN 'weather' THEN 26 WHEN 'holidays' THEN 720 WHEN 'trends' THEN 12 WHEN 'macro' THEN 48
                 WHEN 'events' THEN 26 END AS f, CASE source WHEN 'weather' THEN 24 WHEN 'holidays' THEN 8760
                 WHEN 'trends' THEN 168 WHEN 'macro' THEN 2160 WHEN 'events' THEN 168 END AS t FROM signals)""")
def _(s):
    k = F.col("k")
    runs = s.signals().select("seq", "source", F.col("ingested_at").alias("now"), F.when(
        k % 10 != 0, F.col("ingested_at") - F.make_dt_interval(F.lit(0), k * 5)).alias("last_success_at"))
    return health.health_status(runs, F.col("now")).select("seq", "source", "status")


RUNS = {
    "runs": """
        SELECT source, strftime(ingested_at, '%Y%m%d') AS run_id, max(ingested_at) AS ran_at,
               NOT (source IN ('weather', 'macro') AND max(day(ingested_at)) >= 29) AS ok FROM signals GROUP BY 1, 2""",
    "finish": "SELECT max(ts) AS t FROM events",
}


def runs(s):
    """One run per feed and day; weather and macro fail from the 29th on."""
    ok = ~(F.col("source").isin("weather", "macro") & (F.max(F.dayofmonth("ingested_at")) >= 29))
    return s.signals().groupBy("source", F.date_format("ingested_at", "yyyyMMdd").alias("run_id")).agg(
        F.max("ingested_at").alias("ran_at"), ok.alias("ok"))


def with_run(s):
    return s.signals().withColumn("run_id", F.date_format("ingested_at", "yyyyMMdd"))


def finish(s):
    return s.table("events").agg(F.max("ts")).scalar()


@query("stale_fallback", """
    SELECT seq, s.source, value, true AS stale FROM signals s JOIN (
        SELECT source, arg_max(run_id, ran_at) AS run_id, max(ran_at) AS ran_at FROM runs WHERE ok GROUP BY source) g
    ON g.source = s.source AND g.run_id = strftime(s.ingested_at, '%Y%m%d')
    WHERE (SELECT arg_max(ok, ran_at) FROM runs r WHERE r.source = s.source) = false
      AND g.ran_at >= (SELECT t FROM finish) - to_hours(CASE s.source WHEN 'weather' THEN 24 ELSE 2160 END)""", RUNS)
def _(s):
    return health.stale_fallback(with_run(s), runs(s), finish(s)).select("seq", "source", "value", "stale")


@query("stale_stamp", """
    SELECT seq, concat('{"k":', k, ',"stale":true}') AS payload FROM signals""")
def _(s):
    rows = s.signals().select("seq", F.to_json(F.struct("k")).alias("payload"))
    return health.stale_stamp(rows)


@query("run_report", """
    SELECT r.source, r.run_id, coalesce(p.n, 0) AS published, coalesce(NOT ok AND p.n > 0, false) AS from_cache,
           CASE WHEN ok THEN 'live' WHEN NOT ok AND p.n > 0 THEN 'stale' ELSE 'degraded' END AS status,
           CASE WHEN NOT ok THEN 'fetch failed' END AS error
    FROM runs r LEFT JOIN (
        SELECT source, run_id, count(*) AS n FROM (SELECT *, strftime(ingested_at, '%Y%m%d') AS run_id FROM signals)
        JOIN runs USING (source, run_id) WHERE ok OR k % 2 = 0 GROUP BY 1, 2) p USING (source, run_id)""", RUNS)
def _(s):
    """Failed runs replay every second row of their day; their feeds have not succeeded before."""
    every = runs(s)
    sent = with_run(s).join(every.select("source", "run_id", "ok"), ["source", "run_id"]).filter("ok or k % 2 = 0")
    sent = sent.withColumn("stale", ~F.col("ok"))
    every = every.withColumns({
        "last_success_at": F.when(F.col("ok"), F.col("ran_at")), "error": F.when(~F.col("ok"), "fetch failed")})
    return health.run_report(every, sent, F.col("ran_at"))
