"""Queries: upsert, update, delete and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesflow.catalog.registry import query
from salesflow.operators import merge
from salesflow.schemas import SERIES, SERIES_DAY
from salesflow.sources.layers import lookback


@query("upsert_merge", """
    SELECT user_id, sku, date, CASE WHEN date % 2 = 0 THEN quantity + 1 ELSE quantity END AS quantity, price, source FROM (
        SELECT user_id, sku, date_diff('day', DATE '1970-01-01', date) AS date, quantity, price, 'csv' AS source FROM silver
        WHERE NOT (month(date) = 5 AND day(date) % 2 = 0) OR date_diff('day', DATE '1970-01-01', date) % 2 <> 0
        UNION ALL SELECT user_id, sku, date_diff('day', DATE '1970-01-01', date), quantity, NULL, NULL FROM silver
        WHERE month(date) = 5 AND day(date) % 2 = 0 AND date_diff('day', DATE '1970-01-01', date) % 2 = 0)""")
def _(s):
    """Every second day is re-uploaded with one unit more; some of those days are new to the target."""
    number = F.unix_date("date")
    sales = s.stored("sales_daily", s.sales_daily).select(*SERIES_DAY, "quantity", "price", "source")
    fresh = (F.month("date") == 5) & (F.dayofmonth("date") % 2 == 0) & (number % 2 == 0)
    first = sales.filter(number % 2 == 0).select(*SERIES_DAY, F.lit(-1.0).alias("quantity"), F.lit(1).alias("batch"))
    second = sales.filter(number % 2 == 0).select(
        *SERIES_DAY, (F.col("quantity") + 1).alias("quantity"), F.lit(2).alias("batch"))
    merged = merge.upsert(sales.filter(~fresh), first.unionByName(second), SERIES_DAY, ["batch"])
    return merged.withColumn("date", number.cast("bigint"))


@query("update_by_key", """
    SELECT user_id, sku, product_name, category,
           CASE WHEN category = 'PROMO' OR sku LIKE '%2' THEN CAST(n AS INTEGER) ELSE 0 END AS sales_days,
           CASE WHEN category = 'PROMO' OR sku LIKE '%2' THEN last ELSE last_sale_date END AS last_sale_date
    FROM products JOIN (SELECT user_id, sku, count(*) AS n, max(date) + 1 AS last FROM silver GROUP BY 1, 2) USING (user_id, sku)
    """)
def _(s):
    from salesflow.operators.validation import product_stats

    products = s.stored("products", s.products)
    target = products.withColumn("sales_days", F.lit(0))
    stats = product_stats(s.sales_daily()).withColumn("last_sale_date", F.date_add("last_sale_date", 1))
    picked = products.filter("category = 'PROMO' or sku like '%2'").select(*SERIES)
    return merge.update_by_key(target, stats.join(picked, SERIES, "left_semi"), SERIES, ["sales_days", "last_sale_date"])


@query("delete_by_key", """
    SELECT id, user_id, label, start_date FROM calendar_events c WHERE NOT EXISTS (
        SELECT 1 FROM nation n WHERE n.n_nationkey = c.id AND concat('r', n.n_regionkey) = c.user_id AND n.n_nationkey % 2 = 1)
    """)
def _(s):
    """Each tenant asks to delete the odd entries, its own and those of others; only its own go."""
    asked = s.calendar_events().filter("id % 2 = 1").select("id", "user_id")
    foreign = asked.withColumn("user_id", F.lit("r9"))
    return merge.delete_by_key(s.calendar_events(), asked.unionByName(foreign), ["id", "user_id"]).drop("end_date")


@query("prune_retention", """
    SELECT user_id, sku, forecast_date, model_run_id FROM forecasts
    WHERE generated_at >= (SELECT d FROM as_of) - INTERVAL 7 DAY""")
def _(s):
    kept = merge.prune(s.forecasts(), s.as_of().cast("timestamp_ntz"), "generated_at", 7)
    return kept.select(*SERIES, "forecast_date", "model_run_id")


@query("prune_runs", """
    SELECT user_id, sku, forecast_date, model_run_id FROM forecasts
    WHERE model_run_id >= strftime((SELECT d FROM as_of) - 7, 'nightly-%Y%m%d')""")
def _(s):
    return merge.prune_runs(s.forecasts(), s.as_of(), 7).select(*SERIES, "forecast_date", "model_run_id")


@query("lookback_scan", """
    SELECT seq, source, date FROM signals WHERE date >= (SELECT d FROM as_of) - 400""")
def _(s):
    return lookback(s.signals().select("seq", "source", "date"), s.as_of(), 400, "date")
