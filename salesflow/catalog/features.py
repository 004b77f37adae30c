"""Queries: Silver cleaning, calendar, windows, signal joins and Gold features."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesflow.catalog.registry import query
from salesflow.operators import calendar, features, keyed, silver
from salesflow.schemas import SERIES, SERIES_DAY
from salesflow.sources.sample_tables import SALES_ORDER


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("sales_dedupe_latest", """
    SELECT user_id, sku, date, quantity, round(revenue, 4) AS revenue, price, promo_flag, ingested_at,
           l_orderkey, l_linenumber FROM deduped""")
def _(s):
    kept = silver.dedupe_latest(s.sales_newest(), SALES_ORDER)
    return rounded(kept, "revenue")


@query("latest_per_day", "SELECT user_id, date, temp_avg, precip_mm FROM weather")
def _(s):
    return s.weather()


@query("sales_gap_flag", "SELECT user_id, sku, date, gap_flag FROM silver")
def _(s):
    days = s.sales_days().select(*SERIES_DAY)
    return silver.flag_gaps(days)


@query("sales_to_silver", """
    SELECT user_id, sku, date, quantity, round(revenue, 4) AS revenue, price, promo_flag, gap_flag FROM silver""")
def _(s):
    return rounded(s.silver_sales(), "revenue")


@query("events_to_daily", """
    SELECT user_id, date, event_count, large_event_count, coalesce(array_to_string(categories, '|'), '') AS categories
    FROM events_daily""")
def _(s):
    return s.events_daily().withColumn("categories", F.array_join("categories", "|"))


@query("macro_forward_fill", """
    SELECT k.series, k.date, (SELECT arg_max(m.value, m.date) FROM macro m WHERE m.series = k.series AND m.date <= k.date)
           AS value
    FROM (SELECT DISTINCT series, d.date FROM macro, (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) d) k
    """)
def _(s):
    days = s.table("lineitem").select(F.to_date("l_shipdate").alias("date"))
    return silver.forward_fill(s.macro(), days, ["series"])


@query("calendar_daily", "SELECT user_id, date, is_holiday, days_to_holiday, is_school_break FROM calendar")
def _(s):
    return calendar.calendar_daily(s.spans(), s.profiles(), s.holidays(), s.calendar_events())


def _country_days(s):
    tenants = s.profiles().select(F.col("id").alias("user_id"), "country_code")
    return calendar.day_spine(s.spans()).join(tenants, "user_id")


@query("holiday_join", "SELECT user_id, date, is_holiday FROM calendar")
def _(s):
    return calendar.holiday_flag(_country_days(s), s.holidays()).select("user_id", "date", "is_holiday")


@query("days_to_holiday", "SELECT user_id, date, days_to_holiday FROM calendar")
def _(s):
    return calendar.days_to_next(_country_days(s), s.holidays()).select("user_id", "date", "days_to_holiday")


@query("school_break", "SELECT user_id, date, is_school_break FROM calendar")
def _(s):
    return calendar.in_interval(calendar.day_spine(s.spans()), s.calendar_events(), s.spans())


@query("upload_tenant_join", """
    SELECT c.user_id, label, start_date, end_date FROM calendar_events c JOIN profiles p ON p.id = c.user_id""")
def _(s):
    return calendar.tenant_intervals(s.calendar_events(), s.profiles())


@query("calendar_parts", """
    SELECT date, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(month(date) AS INTEGER) AS month,
           isodow(date) >= 6 AS is_weekend, count(*) AS rows FROM sales_raw GROUP BY ALL""")
def _(s):
    days = s.sales_raw().groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    return features.add_calendar_parts(days)


@query("lag_features", "SELECT user_id, sku, date, lag_1, lag_7, lag_14, lag_28 FROM gold")
def _(s):
    return features.add_lags(s.silver_sales().select(*SERIES_DAY, "quantity")).drop("quantity")


@query("rolling_means", """
    SELECT user_id, sku, date, round(roll_mean_7, 4) AS roll_mean_7, round(roll_mean_28, 4) AS roll_mean_28 FROM gold""")
def _(s):
    rows = features.add_rolls(s.silver_sales().select(*SERIES_DAY, "quantity")).drop("quantity")
    return rounded(rows, "roll_mean_7", "roll_mean_28")


@query("feature_join", """
    SELECT user_id, sku, date, is_holiday, days_to_holiday, is_school_break, temp_avg, precip_mm, trends_interest,
           event_count, large_event_count FROM gold""")
def _(s):
    cal = calendar.calendar_daily(s.spans(), s.profiles(), s.holidays(), s.calendar_events())
    keys = s.sales_days().select(*SERIES_DAY)
    return features.join_signals(keys, s.weather(), cal, s.trends(), s.events_daily())


def gold(s):
    cal = calendar.calendar_daily(s.spans(), s.profiles(), s.holidays(), s.calendar_events())
    return features.gold_features(s.silver_sales(), s.weather(), cal, s.trends(), s.events_daily())


@query("full_gold_features", """
    SELECT * REPLACE (round(roll_mean_7, 4) AS roll_mean_7, round(roll_mean_28, 4) AS roll_mean_28) FROM gold""")
def full_gold_features(s):
    return rounded(gold(s), "roll_mean_7", "roll_mean_28")


@query("distinct_sets", "SELECT country_code, date FROM holidays")
def _(s):
    return s.holidays()


@query("calendar_union", """
    SELECT user_id, CAST(label AS VARCHAR) AS label, start_date AS date FROM calendar_events
    UNION ALL SELECT p.id, 'holiday', h.date FROM holidays h JOIN profiles p USING (country_code)""")
def _(s):
    tenants = s.profiles().select(F.col("id").alias("user_id"), "country_code")
    # A country has many tenants and few holidays: dates are dealt into parts, so that a country is not one task.
    part = F.pmod(F.xxhash64("date"), F.lit(16))
    spread = tenants.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))))
    holidays = s.holidays().withColumn("_part", part).join(spread, ["country_code", "_part"]).select("user_id", F.lit("holiday").alias("label"), "date")
    ranges = s.calendar_events().select("user_id", "label", F.col("start_date").alias("date"))
    return ranges.unionByName(holidays)


@query("signals_concat", """
    SELECT user_id, 'weather' AS source, date, temp_avg AS value FROM weather
    UNION ALL SELECT user_id, 'trends', date, interest FROM trends
    UNION ALL SELECT user_id, 'events', date, CAST(event_count AS DOUBLE) FROM events_daily""")
def _(s):
    def rows(df, source, value):
        return df.select("user_id", F.lit(source).alias("source"), "date", F.col(value).cast("double").alias("value"))
    return rows(s.weather(), "weather", "temp_avg").unionByName(rows(s.trends(), "trends", "interest")).unionByName(
        rows(s.events_daily(), "events", "event_count"))


@query("except", """
    SELECT user_id, sku FROM products EXCEPT ALL SELECT DISTINCT user_id, sku FROM sales_raw
    WHERE date > (SELECT d FROM as_of) - 3""")
def _(s):
    """Requested minus found: series without a sale in the last three days."""
    recent = s.sales_days().filter(F.col("date") > F.date_sub(s.as_of(), 3))
    return keyed.missing_keys(s.products().select(*SERIES), recent, SERIES)
