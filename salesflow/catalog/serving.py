"""Queries: serving reads for all tenants at once, pages, flags and configuration."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from salesflow.catalog.registry import query
from salesflow.operators import health, keyed, merge, search
from salesflow.plans import serving, serving_tables
from salesflow.schemas import SERIES
from salesflow.session import scratch_path
from salesflow.sources import snapshots

FACTOR_NAMES = ["temp_avg", "precip_mm", "event_count", "promo_flag", "dow", "month", "is_holiday"]

NEWEST = {
    "newest": """
        SELECT user_id, arg_max(model_run_id, generated_at) AS model_run_id, max(generated_at) AS generated_at
        FROM forecasts GROUP BY user_id""",
    "requests": """
        SELECT user_id, sku, CAST(split_part(sku, '#', 2) AS INTEGER) AS position,
               CASE WHEN sku LIKE '%1' THEN 7 WHEN sku LIKE '%2' THEN 14 ELSE 30 END AS horizon
        FROM (SELECT user_id, sku FROM products UNION ALL SELECT id, 'Brand#99' FROM profiles)""",
    "outage": "SELECT coalesce(bool_or(status IN ('stale', 'degraded')), false) AS o FROM signal_status",
    "flat": """
        SELECT q.user_id, q.position, q.sku, n.model_run_id, n.generated_at, coalesce(f.model_version, 'seasonal-naive') AS model_version,
               f.mape_backtest,
               (SELECT o FROM outage) OR starts_with(coalesce(f.model_version, 'seasonal-naive'), 'seasonal-naive')
               AS degraded, f.forecast_date, f.yhat, f.yhat_lower, f.yhat_upper
        FROM requests q JOIN newest n USING (user_id)
        LEFT JOIN forecasts f ON f.user_id = q.user_id AND f.sku = q.sku AND f.model_run_id = n.model_run_id
             AND f.forecast_date <= (SELECT d FROM as_of) + q.horizon""",
}


def published(s):
    """The forecast table as the nightly run leaves it, on storage."""
    return s.stored("forecasts", s.forecasts)


def requests(s):
    """Every product of every tenant, and one unknown SKU per tenant."""
    skus = s.products().select(*SERIES).unionByName(
        s.profiles().select(F.col("id").alias("user_id"), F.lit("Brand#99").alias("sku")))
    horizon = F.when(F.endswith("sku", F.lit("1")), 7).when(F.endswith("sku", F.lit("2")), 14).otherwise(30)
    return skus.select(*SERIES, F.element_at(F.split("sku", "#"), 2).cast("int").alias("position"), horizon.alias("horizon"))


def factors(s):
    """Seven factors per forecast series and run, with weights that depend on the series."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("factor"),
                 ((F.ascii(F.substring("sku", -1, 1)) * (i + 1)) % 10 / 10).alias("importance"),
                 F.lit("up" if i % 2 else "down").alias("direction"))
        for i, name in enumerate(FACTOR_NAMES)])
    runs = published(s).select(*SERIES, "model_run_id").distinct()
    return runs.select(*SERIES, "model_run_id", F.explode(entries).alias("f")).select(*SERIES, "model_run_id", "f.*")


@query("latest_run", "SELECT user_id, model_run_id, generated_at FROM newest", NEWEST)
def _(s):
    return serving.latest_run(s.forecasts())


@query("forecasts_api", "SELECT * FROM flat", NEWEST)
def _(s):
    return serving.series_flat(requests(s), published(s), s.signal_status(), s.as_of())


FACTORS = {**NEWEST, "factors": """
    SELECT DISTINCT user_id, sku, model_run_id, f.factor, (ascii(right(sku, 1)) * f.i) %% 10 / 10.0 AS importance,
           CASE WHEN f.i %% 2 = 0 THEN 'up' ELSE 'down' END AS direction
    FROM forecasts CROSS JOIN (SELECT unnest([%s]) AS factor, unnest(range(1, 8)) AS i) f""" % ", ".join(
    f"'{n}'" for n in FACTOR_NAMES), "shown": """
    SELECT user_id, sku, model_run_id, string_agg(concat(factor, ':', CAST(importance AS DECIMAL(6, 4)), ':', direction), '>'
                                                  ORDER BY importance DESC, factor) AS factors FROM (
        SELECT f.*, row_number() OVER (PARTITION BY f.user_id, f.sku ORDER BY importance DESC, factor) AS rn
        FROM factors f JOIN newest n USING (user_id, model_run_id)) WHERE rn <= 5 GROUP BY user_id, sku, model_run_id"""}
POINT = """string_agg(concat_ws('/', strftime(forecast_date, '%Y-%m-%d'), CAST(yhat AS DECIMAL(14, 2)), CAST(yhat_lower AS DECIMAL(14, 2)),
                                CAST(yhat_upper AS DECIMAL(14, 2))), ' ' ORDER BY forecast_date)"""


def shown_points(points):
    """All points of a series as text."""
    money = lambda c: c.cast("decimal(14, 2)").cast("string")
    return F.array_join(F.transform(points, lambda p: F.concat_ws(
        "/", F.date_format(p["date"], "yyyy-MM-dd"), money(p["yhat"]), money(p["yhat_lower"]), money(p["yhat_upper"]))), " ")


def shown_factors(factors):
    """All factors of a series as text."""
    return F.array_join(F.transform(factors, lambda f: F.concat_ws(
        ":", f["factor"], f["importance"].cast("decimal(6, 4)").cast("string"), f["direction"])), ">")


@query("forecast_serving", f"""
    SELECT f.user_id, position, f.sku, f.model_run_id, max(model_version) AS model_version, bool_or(degraded) AS degraded,
           max(mape_backtest) AS mape_backtest, coalesce({POINT}, '') AS points, any_value(s.factors) AS factors
    FROM flat f LEFT JOIN shown s ON s.user_id = f.user_id AND s.sku = f.sku
    GROUP BY f.user_id, position, f.sku, f.model_run_id""", FACTORS)
def _(s):
    """Every point and factor of every series."""
    rows = serving.assemble_series(requests(s), published(s), factors(s), s.signal_status(), s.as_of())
    return rows.select("user_id", "position", "sku", "model_run_id", "model_version", "degraded", "mape_backtest",
                       shown_points(F.col("points")).alias("points"), shown_factors(F.col("factors")).alias("factors"))


ASKED = {**NEWEST, "asked": """
    SELECT upload_id AS request_id, user_id, coalesce(list(trim(sku) ORDER BY row_no, sku) FILTER (trim(sku) <> ''), []) ||
               CASE WHEN CAST(substr(upload_id, 2) AS BIGINT) % 50 = 0 THEN ['Brand#99'] ELSE [] END AS skus,
           CASE CAST(substr(upload_id, 2) AS BIGINT) % 4 WHEN 0 THEN 7 WHEN 1 THEN 14 WHEN 2 THEN 30 ELSE 21 END AS horizon
    FROM upload_rows GROUP BY 1, 2""", "served": "SELECT * FROM forecasts WHERE user_id <> 'r4'", "judged": """
    SELECT *, CASE WHEN len(skus) NOT BETWEEN 1 AND 10 THEN 'sku_count' WHEN horizon NOT IN (7, 14, 30) THEN 'horizon'
                   WHEN EXISTS (SELECT 1 FROM (SELECT unnest(skus) AS k) WHERE NOT EXISTS (
                        SELECT 1 FROM products p WHERE p.user_id = a.user_id AND p.sku = k)) THEN 'sku_not_found'
                   WHEN EXISTS (SELECT 1 FROM products p WHERE p.user_id = a.user_id AND list_contains(a.skus, p.sku)
                        AND coalesce(sales_days, 0) < 450) THEN 'insufficient_history'
                   WHEN user_id = 'r4' THEN 'no_run' ELSE 'ok' END AS outcome FROM asked a"""}


def asked(s):
    """Every upload as a request for its SKUs; some name an unknown one, some a horizon that is not offered."""
    number = F.substring("request_id", 2, 20).cast("bigint")
    rows = s.upload_rows().groupBy(F.col("upload_id").alias("request_id"), "user_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("row_no", "sku"))), lambda x: x["sku"]).alias("skus"))
    return rows.withColumns({
        "skus": F.concat("skus", F.when(number % 50 == 0, F.array(F.lit("Brand#99"))).otherwise(F.array().cast("array<string>"))),
        "horizon": F.when(number % 4 == 0, 7).when(number % 4 == 1, 14).when(number % 4 == 2, 30).otherwise(21)})


@query("forecast_requests", """
    SELECT request_id, user_id, array_to_string(skus, ',') AS skus, horizon, outcome FROM judged""", ASKED)
def _(s):
    judged = serving.judge_requests(asked(s), s.products(), s.forecasts().filter("user_id <> 'r4'"), 450)
    return judged.select("request_id", "user_id", F.array_join("skus", ",").alias("skus"), "horizon", "outcome")


@query("forecast_responses", f"""
    SELECT request_id, outcome, CASE WHEN outcome = 'ok' THEN model_run_id END AS model_run_id,
           CASE WHEN outcome = 'ok' THEN generated_at END AS generated_at, md5(series) AS series,
           CASE WHEN outcome = 'ok' THEN (SELECT string_agg(concat(signal, ':', status), ',' ORDER BY signal) FROM signal_status) END AS feeds
    FROM judged LEFT JOIN served_runs USING (user_id) LEFT JOIN bodies USING (request_id)""", {**FACTORS, **ASKED, "served_runs": """
    SELECT user_id, arg_max(model_run_id, generated_at) AS model_run_id, max(generated_at) AS generated_at FROM served GROUP BY user_id""",
    "parts": """
    SELECT request_id, user_id, unnest(skus) AS sku, unnest(range(len(skus))) AS position, horizon FROM judged WHERE outcome = 'ok'""",
    "bodies": f"""
    SELECT request_id, string_agg(concat_ws('|', position, sku, model_version, degraded, points, factors), ';' ORDER BY position) AS series FROM (
        SELECT p.request_id, p.position, p.sku, coalesce(max(f.model_version), 'seasonal-naive') AS model_version,
               (SELECT o FROM outage) OR starts_with(coalesce(max(f.model_version), 'seasonal-naive'), 'seasonal-naive') AS degraded,
               coalesce({POINT}, '') AS points, coalesce(any_value(x.factors), '') AS factors
        FROM parts p JOIN served_runs r USING (user_id) LEFT JOIN served f ON f.user_id = p.user_id AND f.sku = p.sku
             AND f.model_run_id = r.model_run_id AND f.forecast_date <= (SELECT d FROM as_of) + p.horizon
        LEFT JOIN shown x ON x.user_id = p.user_id AND x.sku = p.sku GROUP BY p.request_id, p.position, p.sku) GROUP BY request_id"""})
def _(s):
    """Every series of every answer in the order asked for, with all points and factors, as one text's hash."""
    tables = {"products": s.products(), "forecasts": published(s).filter("user_id <> 'r4'"), "forecast_factors": factors(s),
              "signal_status": s.signal_status()}
    rows = serving.forecast_responses(asked(s), tables, s.as_of(), 450)
    one = lambda x: F.concat_ws("|", x["position"].cast("string"), x["sku"], x["model_version"], x["degraded"].cast("string"),
                                shown_points(x["points"]), shown_factors(x["factors"]))
    feeds = F.array_join(F.transform("signal_health", lambda h: F.concat_ws(":", h["signal"], h["status"])), ",")
    return rows.select("request_id", "outcome", "model_run_id", "generated_at", F.md5(F.array_join(F.transform("series", one), ";")).alias("series"),
                       feeds.alias("feeds"))


@query("forecast_point_read", f"""
    SELECT f.user_id, f.sku, f.model_run_id, coalesce({POINT}, '') AS points, any_value(s.factors) AS factors
    FROM forecasts f JOIN newest n ON n.user_id = f.user_id AND n.model_run_id = f.model_run_id
    JOIN (SELECT DISTINCT user_id, sku FROM (
        SELECT user_id, sku, row_number() OVER (PARTITION BY user_id ORDER BY sku) AS rn FROM products) WHERE rn <= 10 AND user_id = 'r1') q
      ON q.user_id = f.user_id AND q.sku = f.sku
    LEFT JOIN shown s ON s.user_id = f.user_id AND s.sku = f.sku
    WHERE f.forecast_date <= (SELECT d FROM as_of) + 30 GROUP BY f.user_id, f.sku, f.model_run_id""", FACTORS)
def _(s):
    """The first ten SKUs of a tenant from stored runs."""
    root = stored_runs(s)
    return point_read(s, root, [r.sku for r in serving.tenant_view(s.products(), "r1").orderBy("sku").limit(10).collect()])


def stored_runs(s):
    """Both runs of the forecast table as the nightly run stores them."""
    root, shown = scratch_path(s.spark, "serving"), factors(s)
    held = published(s).withColumns({c: F.col(c).cast("decimal(14, 2)") for c in ("yhat", "yhat_lower", "yhat_upper")}).withColumns(
        {"mape_backtest": F.col("mape_backtest").cast("decimal(6, 2)"), "generated_at": F.col("generated_at").cast("timestamp")})
    for run in [r.model_run_id for r in held.select("model_run_id").distinct().collect()]:
        own = F.col("model_run_id") == run
        tables = serving_tables.run_tables(held.filter(own), shown.filter(own).withColumn("importance", F.col("importance").cast("decimal(6, 4)")))
        snapshots.publish(s.spark, root, snapshots.write_run(s.spark, root, run, run, tables))
    return root


def point_read(s, root, skus):
    rows = serving_tables.serve(s.spark, root, "r1", skus, 30, s.signal_status(), s.as_of())
    return rows.select("user_id", "sku", "model_run_id", shown_points(F.col("points")).alias("points"), shown_factors(F.col("factors")).alias("factors"))


@query("degraded_flag", """
    SELECT DISTINCT f.user_id, f.sku, f.model_version,
           (SELECT o FROM outage) OR starts_with(f.model_version, 'seasonal-naive') AS degraded FROM forecasts f""", NEWEST)
def _(s):
    rows = s.forecasts().select(*SERIES, "model_version").distinct()
    return rows.withColumn("_o", serving.any_degraded(s.signal_status())).select(
        *SERIES, "model_version", (F.col("_o") | F.startswith("model_version", F.lit("seasonal-naive"))).alias("degraded"))


@query("missing_skus", """
    SELECT user_id, sku FROM requests q WHERE NOT EXISTS (
        SELECT 1 FROM products p WHERE p.user_id = q.user_id AND p.sku = q.sku)""", NEWEST)
def _(s):
    return keyed.missing_keys(requests(s).select(*SERIES), s.products(), SERIES)


@query("insufficient_history", "SELECT user_id, sku, sales_days FROM products WHERE coalesce(sales_days, 0) < 450")
def _(s):
    return serving.insufficient(s.products(), 450).select(*SERIES, "sales_days")


@query("has_forecast", """
    SELECT p.user_id, p.sku, EXISTS (SELECT 1 FROM forecasts f WHERE f.user_id = p.user_id AND f.sku = p.sku
           AND f.yhat > 45) AS has_forecast FROM products p""")
def _(s):
    return keyed.flag_exists(s.products().select(*SERIES), s.forecasts().filter("yhat > 45"), SERIES, "has_forecast")


@query("products_list", """
    SELECT user_id, sku, product_name, sales_days, last_sale_date, CAST(rn AS INTEGER) AS position, true AS has_forecast FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sku) AS rn FROM products
        WHERE contains(lower(product_name), 'o')) WHERE rn > 3 AND rn <= 7""")
def _(s):
    rows = serving.products_all(s.products(), s.forecasts(), search="O", limit=4, offset=3)
    return rows.drop("category")


@query("ilike_search", "SELECT user_id, sku, product_name FROM products WHERE product_name ILIKE '%RING%'")
def _(s):
    return serving.search_products(s.products(), "RING").select(*SERIES, "product_name")


@query("trigram_search", r"""
    SELECT 'ring' AS pattern, user_id, sku, product_name FROM products WHERE product_name ILIKE '%ring%'
    UNION ALL SELECT 'r_n', user_id, sku, product_name FROM products WHERE product_name ILIKE '%r_n%'
    UNION ALL SELECT 'SMA%R', user_id, sku, product_name FROM products WHERE product_name ILIKE '%SMA%R%'
    UNION ALL SELECT 'e', user_id, sku, product_name FROM products WHERE product_name ILIKE '%e%'""")
def _(s):
    """Names by patterns of one, two and three and more plain characters, from an index kept in two steps."""
    names, path = s.stored("products", s.products).select(*SERIES, "product_name"), scratch_path(s.spark, "postings")
    half = F.pmod(F.xxhash64(*SERIES), F.lit(2)) == 0
    search.index_names(names.withColumn("product_name", F.when(half, F.col("product_name")).otherwise("an earlier name")), path)
    search.index_names(names.filter(~half), path)
    out = None
    for text in ("ring", "r_n", "SMA%R", "e"):
        found = search.search_names(s.spark, path, names, text).select(F.lit(text).alias("pattern"), *names.columns)
        out = found if out is None else out.unionByName(found)
    return out


@query("sales_history", """
    SELECT user_id, sku, date, quantity, round(revenue, 4) AS revenue, promo_flag FROM silver
    WHERE date BETWEEN (SELECT d FROM as_of) - 90 AND (SELECT d FROM as_of) - 10""")
def _(s):
    rows = serving.sales_between(s.sales_daily(), F.date_sub(s.as_of(), 90), F.date_sub(s.as_of(), 10))
    return rows.select(*SERIES, "date", "quantity", F.round("revenue", 4).alias("revenue"), "promo_flag")


@query("sales_range", """
    SELECT user_id, sku, date, quantity FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, sku ORDER BY date) AS rn FROM silver
        WHERE date >= (SELECT d FROM as_of) - 700) WHERE rn <= 20""")
def _(s):
    """First twenty days of the range of every series."""
    rows = serving.sales_between(s.sales_daily(), start=F.date_sub(s.as_of(), 700))
    return keyed.top_n(rows.select(*SERIES, "date", "quantity"), SERIES, [F.col("date")], 20)


@query("tenant_filter", """
    SELECT user_id, count(*) AS rows, sum(quantity) AS quantity FROM sales_raw
    WHERE user_id IN (SELECT id FROM profiles WHERE latitude IS NOT NULL) GROUP BY user_id""")
def _(s):
    viewers = s.profiles().filter("latitude is not null")
    return serving.visible_to(s.sales_raw(), viewers).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity"))


@query("uploads_list", """
    SELECT user_id, id, created_at, CAST(rn AS INTEGER) AS position FROM (
        SELECT concat('r', o_custkey % 5) AS user_id, concat('u', o_orderkey) AS id, o_orderdate AS created_at,
               row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    WHERE rn <= 50""")
def _(s):
    rows = s.table("orders").select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string")).alias("user_id"),
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("_k"))
    return keyed.page_per_key(rows, ["user_id"], [F.desc("created_at"), F.desc("_k")], 0, 50).drop("_k")


@query("list_page", """
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""")
def _(s):
    rows = s.table("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return keyed.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], offset=100, limit=50)


@query("seek_page", """
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01' OR (o_orderdate = TIMESTAMP '1996-06-01' AND o_orderkey > 100)
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def _(s):
    """The page behind a given row, without the rows ahead of it."""
    rows = s.table("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return keyed.seek(rows, [("o_orderdate", True), ("o_orderkey", False)], [datetime(1996, 6, 1), 100], 50)


@query("page_scan", """
    SELECT event_id, ts, event_type, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS page FROM events""")
def _(s):
    """All pages of the table."""
    return keyed.pages(s.table("events").select("event_id", "ts", "event_type"), ["event_id"], 1000)


@query("ordered_lists", "SELECT user_id, label, start_date, end_date FROM calendar_events ORDER BY start_date, id")
def _(s):
    return s.calendar_events().orderBy("start_date", "id").drop("id")


@query("sku_picker", """
    SELECT user_id, sku, product_name FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sku) AS rn FROM products
        WHERE (contains(lower(sku), '1') OR contains(lower(product_name), '1')) AND sales_days % 3 <> 0) WHERE rn <= 20""")
def _(s):
    return serving.sku_picker(s.products(), s.products().filter("sales_days % 3 = 0"), "1").select(*SERIES, "product_name")


@query("signal_settings_view", """
    SELECT user_id, signal, CASE WHEN signal = 'trends' THEN true ELSE enabled END AS enabled FROM settings
    UNION ALL SELECT p.id, 'trends', true FROM profiles p
    WHERE NOT EXISTS (SELECT 1 FROM settings s WHERE s.user_id = p.id AND s.signal = 'trends')""")
def _(s):
    patch = s.profiles().select(
        F.col("id").alias("user_id"), F.explode(F.array(
            F.struct(F.lit("trends").alias("signal"), F.lit(True).alias("enabled")),
            F.struct(F.lit("macro").alias("signal"), F.lit(None).cast("boolean").alias("enabled")))).alias("p"))
    return serving.signal_settings(s.settings(), patch.select("user_id", "p.*"))


@query("signal_status_view", "SELECT signal, status, last_success_at, last_error FROM signal_status")
def _(s):
    return serving.signal_status(s.signal_status())


@query("health_summary", """
    SELECT count(*) FILTER (status = 'live') AS live, count(*) AS feeds FROM signal_status""")
def _(s):
    return serving.health_summary(s.signal_status())


SEEDED = {"seeded": """
    SELECT user_id, signal, enabled FROM settings
    UNION ALL SELECT t.user_id, g.signal, g.signal <> 'marketplace' FROM (SELECT concat('r', r_regionkey) AS user_id FROM region) t
    CROSS JOIN (SELECT unnest(['weather', 'holidays', 'trends', 'macro', 'events', 'marketplace']) AS signal) g
    WHERE NOT EXISTS (SELECT 1 FROM settings s WHERE s.user_id = t.user_id AND s.signal = g.signal)"""}


@query("seed_settings", "SELECT * FROM seeded", SEEDED)
def _(s):
    return health.seed_settings(s.profiles().select(F.col("id").alias("user_id")), s.settings())


@query("profile_upsert", """
    SELECT id, country_code, CASE WHEN country_code = 'C1' THEN concat(city, '!') ELSE city END AS city, latitude, longitude,
           timezone, currency, country_code = 'C1' AS onboarding_complete FROM profiles""")
def _(s):
    profiles = s.profiles().withColumn("onboarding_complete", F.lit(False))
    changed = s.profiles().filter("country_code = 'C1'").select("id", F.concat("city", F.lit("!")).alias("city"))
    return serving.upsert_profile(profiles, s.settings(), changed)[0]


@query("producer_config", """
    SELECT 'location' AS part, id AS user_id, concat(CAST(CAST(latitude * 100 AS INTEGER) AS VARCHAR), ' ', timezone) AS value
    FROM profiles WHERE latitude IS NOT NULL
    UNION ALL SELECT DISTINCT 'country', '', country_code FROM profiles
    UNION ALL SELECT DISTINCT 'signal', '', signal FROM settings WHERE enabled
    UNION ALL SELECT DISTINCT 'keyword', user_id, category FROM products
    UNION ALL SELECT 'geo', id, country_code FROM profiles""")
def _(s):
    parts = health.producer_config(s.profiles(), s.settings(), s.products())

    def rows(part, name, user, value):
        return parts[name].select(F.lit(part).alias("part"), user.alias("user_id"), value.alias("value"))

    user, nobody = F.col("user_id"), F.lit("")
    place = F.concat((F.col("latitude") * 100).cast("int").cast("string"), F.lit(" "), F.col("timezone"))
    return (
        rows("location", "locations", user, place)
        .unionByName(rows("country", "country_codes", nobody, F.col("country_code")))
        .unionByName(rows("signal", "enabled_signals", nobody, F.col("signal")))
        .unionByName(rows("keyword", "category_keywords", user, F.col("keyword")))
        .unionByName(rows("geo", "geo_by_user", user, F.col("country_code"))))


@query("category_keywords", """
    SELECT DISTINCT user_id, trim(category) AS category, trim(category) AS keyword FROM sales_raw WHERE trim(category) <> ''
    """)
def _(s):
    return health.category_keywords(s.sales_raw().select("user_id", "category"))


@query("country_codes", "SELECT DISTINCT country_code FROM profiles")
def _(s):
    return health.country_codes(s.profiles())


@query("enabled_signals", "SELECT DISTINCT signal FROM settings WHERE enabled")
def _(s):
    return health.enabled_signals(s.settings())


@query("enabled_signals_per_tenant", "SELECT DISTINCT user_id, signal FROM settings WHERE enabled")
def _(s):
    return health.enabled_signals(s.settings(), per_tenant=True)


@query("signal_gating", """
    SELECT signal, bool_or(enabled) AS enabled, bool_or(enabled) AS runs FROM settings GROUP BY signal""")
def _(s):
    return health.signal_gating(s.settings(), s.profiles(), s.products(), s.asins())


@query("asin_quota", """
    SELECT user_id, count(*) AS used, CAST(10 AS BIGINT) AS cap, concat(count(*), ' of 10 used') AS label FROM asins GROUP BY user_id""")
def _(s):
    return serving.asin_quota(s.asins())


@query("latest_runs_kept", """
    SELECT f.user_id, f.sku, f.forecast_date, f.model_run_id, f.yhat FROM forecasts f JOIN newest n USING (user_id, model_run_id)
    """, NEWEST)
def _(s):
    return merge.keep_runs(published(s), 1).select(*SERIES, "forecast_date", "model_run_id", "yhat")
