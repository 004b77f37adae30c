"""SQL text of the sample views, used to build the comparison queries."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "sales_raw": """
        SELECT concat('r', n_regionkey) AS user_id, p_brand AS sku, CAST(l_shipdate AS DATE) AS date,
               l_quantity AS quantity, l_extendedprice * (1 - l_discount) AS revenue, p_retailprice AS price,
               (p_type = 'PROMO') AS promo_flag, o_orderdate AS ingested_at, l_orderkey, l_linenumber,
               p_name AS product_name, p_type AS category, p_partkey AS part_key
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "as_of": "SELECT CAST(max(l_shipdate) AS DATE) AS d FROM lineitem",
    "deduped": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, sku, date ORDER BY ingested_at DESC, l_orderkey DESC,
                   l_linenumber DESC, quantity DESC, revenue DESC) AS rn FROM sales_raw) WHERE rn = 1""",
    "silver": """
        SELECT user_id, sku, date, greatest(quantity, 0.0) AS quantity, revenue, price,
               coalesce(promo_flag, false) AS promo_flag,
               coalesce(date - lag(date) OVER (PARTITION BY user_id, sku ORDER BY date) > 1, false) AS gap_flag
        FROM deduped""",
    "signals": """
        SELECT event_id AS seq,
               CASE event_type WHEN 'view' THEN 'weather' WHEN 'click' THEN 'trends' WHEN 'signup' THEN 'holidays'
                    WHEN 'purchase' THEN 'events' WHEN 'error' THEN 'macro' END AS source,
               CAST(DATE '1995-01-02' + CAST(event_id % 2499 AS INTEGER) AS DATE) AS date, ts AS ingested_at,
               concat('r', user_id % 5) AS user_id, concat('C', user_id % 3) AS country_code,
               CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, value
        FROM events""",
    "weather_raw": """
        SELECT user_id, date, value AS temp_avg, CAST(k % 10 AS DOUBLE) AS precip_mm, ingested_at, seq
        FROM signals WHERE source = 'weather'""",
    "trends_raw": """
        SELECT user_id, date, CAST(least(k, 100) AS DOUBLE) AS interest, ingested_at, seq
        FROM signals WHERE source = 'trends'""",
    "holidays": "SELECT DISTINCT country_code, date FROM signals WHERE source = 'holidays'",
    "events_raw": """
        SELECT user_id, date, concat('e', seq) AS event_id,
               CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'Music' WHEN 2 THEN 'Sports' WHEN 3 THEN 'Arts' END AS category,
               k >= 80 AS large_venue, ingested_at, seq
        FROM signals WHERE source = 'events'""",
    "macro_raw": """
        SELECT concat('S', k % 4) AS series, date, value, ingested_at, seq FROM signals WHERE source = 'macro'""",
    "weather": """
        SELECT user_id, date, temp_avg, precip_mm FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY ingested_at DESC, seq DESC) AS rn
            FROM weather_raw) WHERE rn = 1""",
    "trends": """
        SELECT user_id, date, interest FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY ingested_at DESC, seq DESC) AS rn
            FROM trends_raw) WHERE rn = 1""",
    "events_daily": """
        SELECT user_id, date, count(*) AS event_count, count(*) FILTER (large_venue) AS large_event_count,
               list_sort(list(DISTINCT category) FILTER (category <> '')) AS categories
        FROM events_raw GROUP BY user_id, date""",
    "macro": """
        SELECT series, date, value FROM (
            SELECT *, row_number() OVER (PARTITION BY series, date ORDER BY ingested_at DESC, seq DESC) AS rn
            FROM macro_raw) WHERE rn = 1""",
    "profiles": """
        SELECT concat('r', r_regionkey) AS id, concat('C', r_regionkey % 3) AS country_code, r_name AS city,
               CASE WHEN r_regionkey < 4 THEN CAST(r_regionkey AS DOUBLE) * 10.5 END AS latitude,
               CASE WHEN r_regionkey < 4 THEN CAST(r_regionkey AS DOUBLE) * -20.25 END AS longitude,
               'UTC' AS timezone, 'USD' AS currency
        FROM region""",
    "calendar_events": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, concat('r', n_regionkey) AS user_id, n_name AS label,
               CAST(DATE '1995-01-15' + n_nationkey * 90 AS DATE) AS start_date,
               CAST(DATE '1995-01-15' + n_nationkey * 90 + 6 + n_nationkey % 10 AS DATE) AS end_date
        FROM nation""",
    "spans": """
        SELECT id AS user_id, (SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem) AS start_date,
               (SELECT d FROM as_of) AS end_date FROM profiles""",
    "spine": """
        SELECT user_id, CAST(unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP),
               INTERVAL 1 DAY)) AS DATE) AS date FROM spans""",
    "calendar": """
        SELECT s.user_id, s.date,
               coalesce(min(h.date - s.date) = 0, false) AS is_holiday,
               CAST(min(h.date - s.date) AS INTEGER) AS days_to_holiday,
               coalesce(bool_or(b.user_id IS NOT NULL), false) AS is_school_break
        FROM spine s LEFT JOIN profiles p ON p.id = s.user_id
        LEFT JOIN holidays h ON h.country_code = p.country_code AND h.date BETWEEN s.date AND s.date + 30
        LEFT JOIN calendar_events b ON b.user_id = s.user_id AND s.date BETWEEN b.start_date AND b.end_date
        GROUP BY s.user_id, s.date""",
    "gold": """
        SELECT s.user_id, s.sku, s.date, s.quantity, CAST(isodow(s.date) - 1 AS INTEGER) AS dow,
               CAST(month(s.date) AS INTEGER) AS month, isodow(s.date) >= 6 AS is_weekend, s.promo_flag, s.gap_flag,
               lag(quantity, 1) OVER w AS lag_1, lag(quantity, 7) OVER w AS lag_7,
               lag(quantity, 14) OVER w AS lag_14, lag(quantity, 28) OVER w AS lag_28,
               avg(quantity) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll_mean_7,
               avg(quantity) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS roll_mean_28,
               coalesce(c.is_holiday, false) AS is_holiday, c.days_to_holiday,
               coalesce(c.is_school_break, false) AS is_school_break, w2.temp_avg, w2.precip_mm,
               t.interest AS trends_interest, coalesce(e.event_count, 0) AS event_count,
               coalesce(e.large_event_count, 0) AS large_event_count
        FROM silver s LEFT JOIN calendar c USING (user_id, date) LEFT JOIN weather w2 USING (user_id, date)
        LEFT JOIN trends t USING (user_id, date) LEFT JOIN events_daily e USING (user_id, date)
        WINDOW w AS (PARTITION BY s.user_id, s.sku ORDER BY s.date)""",
    "products": """
        SELECT user_id, sku, arg_min(product_name, part_key) AS product_name, arg_min(category, part_key) AS category,
               CAST(count(DISTINCT date) AS INTEGER) AS sales_days, max(date) AS last_sale_date
        FROM sales_raw GROUP BY user_id, sku""",
    "ranked": """
        SELECT user_id, sku, date, quantity,
               row_number() OVER (PARTITION BY user_id, sku ORDER BY date) AS rn,
               row_number() OVER (PARTITION BY user_id, sku ORDER BY date DESC) AS rd,
               lag(quantity, 7) OVER (PARTITION BY user_id, sku ORDER BY date) AS week_ago
        FROM silver""",
    "naive_stats": """
        SELECT user_id, sku, count(*) AS n, avg(quantity) FILTER (rd <= 28) AS tail_mean,
               coalesce(sqrt(avg((quantity - week_ago) * (quantity - week_ago))),
                        greatest(0.2 * avg(quantity) FILTER (rd <= 28), 1.0)) AS sigma
        FROM ranked GROUP BY user_id, sku""",
    "naive_points": """
        SELECT s.user_id, s.sku, step, coalesce(r.quantity, s.tail_mean) AS raw,
               1.2816 * s.sigma * sqrt(step) AS spread
        FROM naive_stats s CROSS JOIN (SELECT unnest(range(1, 31)) AS step) h
        LEFT JOIN ranked r ON r.user_id = s.user_id AND r.sku = s.sku
             AND r.rn = CASE WHEN n >= 7 THEN n - 7 + (step - 1) % 7 + 1 ELSE (n + step - 1) % 7 + 1 END""",
    "naive": """
        SELECT user_id, sku, CAST((SELECT d FROM as_of) + CAST(step AS INTEGER) AS DATE) AS date,
               greatest(raw, 0.0) AS yhat, greatest(raw - spread, 0.0) AS yhat_lower, raw + spread AS yhat_upper
        FROM naive_points""",
    "forecasts": """
        SELECT user_id, sku, CAST(date - back AS DATE) AS forecast_date,
               strftime((SELECT d FROM as_of) - back, 'nightly-%Y%m%d') AS model_run_id,
               CASE WHEN ascii(right(sku, 1)) % 2 = 0 THEN 'seasonal-naive' ELSE 'boosted:1' END AS model_version,
               round(yhat + CASE WHEN back = 8 THEN 1 ELSE 0 END, 2) AS yhat,
               round(yhat_lower + CASE WHEN back = 8 THEN 1 ELSE 0 END, 2) AS yhat_lower,
               round(yhat_upper + CASE WHEN back = 8 THEN 1 ELSE 0 END, 2) AS yhat_upper,
               CAST(12.5 AS DOUBLE) AS mape_backtest,
               CAST((SELECT d FROM as_of) - back AS TIMESTAMP) AS generated_at
        FROM naive CROSS JOIN (SELECT unnest([0, 8]) AS back) b""",
    "health_reports": """
        SELECT source AS signal, CASE WHEN k < 5 THEN 'degraded' WHEN k < 10 THEN 'stale' ELSE 'live' END AS status,
               CASE WHEN k >= 10 THEN ingested_at END AS last_success_at,
               CASE WHEN k < 10 THEN concat('error ', k) END AS last_error, ingested_at AS reported_at, seq
        FROM signals""",
    "signal_status": """
        SELECT signal, status, last_success_at, last_error, reported_at FROM (
            SELECT *, row_number() OVER (PARTITION BY signal ORDER BY reported_at DESC, seq DESC) AS rn
            FROM health_reports) WHERE rn = 1""",
    "settings": """
        SELECT concat('r', n_regionkey) AS user_id,
               (['weather', 'holidays', 'trends', 'macro'])[n_nationkey % 4 + 1] AS signal,
               max(n_nationkey) % 2 = 0 AS enabled
        FROM nation GROUP BY 1, 2""",
    "asins": """
        SELECT concat('r', n_regionkey) AS user_id,
               CASE WHEN s_suppkey % 11 = 0 THEN concat('b-', lpad(CAST(s_suppkey AS VARCHAR), 8, '0'))
                    ELSE concat('B0', lpad(CAST(s_suppkey AS VARCHAR), 8, '0')) END AS asin, s_suppkey AS created_at
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "upload_rows": """
        SELECT concat('u', l_orderkey) AS upload_id, concat('r', o_custkey % 5) AS user_id,
               l_linenumber + 1 AS row_no,
               CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN strftime(l_shipdate, '%m/%d/%Y')
                    ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
               CASE WHEN l_partkey % 97 = 0 THEN ' ' ELSE p_brand END AS sku,
               CASE WHEN l_partkey % 10 = 0 THEN '' ELSE p_name END AS product_name,
               concat(CASE WHEN l_linenumber = 6 THEN '-' ELSE '' END, CAST(l_quantity AS INTEGER)) AS quantity,
               CASE WHEN l_linenumber = 5 AND l_linestatus = 'N' THEN 'oops' WHEN l_partkey % 13 = 0 THEN ''
                    ELSE '10.5' END AS revenue,
               CASE WHEN l_partkey % 89 = 0 THEN '-1' WHEN l_partkey % 2 = 0 THEN ' 4.25 ' ELSE '' END AS price,
               CASE WHEN l_linenumber = 4 AND l_returnflag = 'A' THEN 'maybe' WHEN p_type = 'PROMO' THEN 'TRUE'
                    ELSE '' END AS promo_flag, l_partkey AS seq
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` with the views it names, and theirs, as leading CTEs."""
    views = {**VIEWS, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        text = re.sub(r"'[^']*'", "''", text)
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b(?!\s*\.)(?!\()", text):
                needed.add(name)
                visit(views[name])

    visit(sql)
    ordered = [f"{name} AS ({views[name]})" for name in views if name in needed]
    return f"WITH {', '.join(ordered)} {sql}" if ordered else sql
