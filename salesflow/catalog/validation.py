"""Queries: upload validation, caps, status, profile and marketplace checks, text scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesflow.catalog.registry import query
from salesflow.operators import days, scan, validation
from salesflow.operators.keyed import top_n
from salesflow.session import scratch_path

MAX_ROWS, MAX_SKUS = 6, 3  # of the queries about the limits themselves


def checked_views(max_rows: int, max_skus: int) -> dict[str, str]:
    """Views with the outcome of every upload row; ``beyond`` is the error of uploads above the row limit."""
    return {
        "cleaned": f"""
            SELECT upload_id, user_id, row_no, seq, trim(date) AS date, trim(sku) AS sku, trim(product_name) AS product_name,
                   trim(quantity) AS quantity, trim(revenue) AS revenue, trim(price) AS price, lower(trim(promo_flag)) AS promo_flag
            FROM upload_rows""",
        "accepted_skus": f"""
            SELECT upload_id, sku FROM (
                SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY first_row, sku) AS rn FROM (
                    SELECT upload_id, sku, min(row_no) AS first_row FROM cleaned WHERE sku <> '' GROUP BY 1, 2))
            WHERE rn <= {max_skus}""",
        "checked": f"""
            SELECT c.*, CASE WHEN c.sku = '' THEN 'sku' WHEN a.sku IS NULL THEN 'sku'
                        WHEN NOT regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'date'
                        WHEN CAST(quantity AS DOUBLE) < 0 THEN 'quantity'
                        WHEN revenue <> '' AND TRY_CAST(revenue AS DOUBLE) IS NULL THEN 'revenue'
                        WHEN price <> '' AND CAST(price AS DOUBLE) < 0 THEN 'price'
                        WHEN promo_flag NOT IN ('true', '1', 'yes', 'false', '0', 'no', '') THEN 'promo_flag' END AS field,
                   CASE WHEN c.sku = '' THEN 'sku is required' WHEN a.sku IS NULL THEN 'SKU limit exceeded ({max_skus} per file)'
                        WHEN NOT regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'date must be ISO YYYY-MM-DD'
                        WHEN CAST(quantity AS DOUBLE) < 0 THEN 'quantity must be >= 0'
                        WHEN revenue <> '' AND TRY_CAST(revenue AS DOUBLE) IS NULL
                        THEN concat('revenue could not convert string to float: ''', revenue, '''')
                        WHEN price <> '' AND CAST(price AS DOUBLE) < 0 THEN 'price must be >= 0'
                        WHEN promo_flag NOT IN ('true', '1', 'yes', 'false', '0', 'no', '')
                        THEN 'must be true/false/0/1' END AS message
            FROM cleaned c LEFT JOIN accepted_skus a USING (upload_id, sku)""",
        "beyond": f"""
            SELECT upload_id, CAST(min(row_no) AS INTEGER) AS row, 'file' AS field,
                   'Row limit exceeded ({max_rows})' AS message
            FROM upload_rows WHERE row_no - 1 > {max_rows} GROUP BY upload_id""",
    }


CHECKED = checked_views(MAX_ROWS, MAX_SKUS)


def checked(s):
    return validation.validate_sales(s.upload_rows(), max_skus=MAX_SKUS)


@query("csv_sales_validate", """
    SELECT upload_id, row_no, seq, sku, field, message,
           CASE WHEN field IS NULL THEN CAST(date AS DATE) END AS date,
           CASE WHEN field IS NULL THEN CAST(quantity AS DOUBLE) END AS quantity,
           CASE WHEN field IS NULL THEN TRY_CAST(revenue AS DOUBLE) END AS revenue,
           CASE WHEN field IS NULL THEN TRY_CAST(price AS DOUBLE) END AS price,
           CASE WHEN field IS NULL THEN promo_flag IN ('true', '1', 'yes') END AS promo_flag
    FROM checked""", CHECKED)
def _(s):
    return validation.outcome(checked(s)).select(
        "upload_id", "row_no", "seq", "sku", "field", "message", "date", "quantity", "revenue", "price", "promo_flag")


@query("csv_row_cap", "SELECT upload_id, row, field, message FROM beyond", CHECKED)
def _(s):
    return validation.row_cap(s.upload_rows(), MAX_ROWS)[1]


@query("upload_errors", """
    SELECT upload_id, CAST(row_no AS INTEGER) AS row, field, message FROM checked WHERE field IS NOT NULL""", CHECKED)
def _(s):
    return validation.error_rows(checked(s))


@query("row_limit_errors", f"""
    SELECT upload_id, CAST(row_no AS INTEGER) AS row, field, message FROM checked WHERE field IS NOT NULL AND row_no - 1 <= {MAX_ROWS}
    UNION ALL SELECT upload_id, row, field, message FROM beyond""", checked_views(MAX_ROWS, 10 ** 9))
def _(s):
    """Uploads under the row limit of the contract: the limit's error comes with the others."""
    return validation.error_rows(validation.validate_sales(s.upload_rows(), max_rows=MAX_ROWS))


@query("sku_cap", "SELECT upload_id, sku FROM accepted_skus", CHECKED)
def _(s):
    rows = s.upload_rows().withColumn("sku", F.trim("sku"))
    return validation.sku_cap(rows, MAX_SKUS).select("upload_id", "sku")


@query("upload_status", """
    SELECT upload_id, CASE WHEN count(*) FILTER (field IS NULL) > 0 THEN 'loaded' ELSE 'failed' END AS status,
           CAST(count(*) FILTER (field IS NULL) AS INTEGER) AS row_count,
           CAST(count(*) FILTER (field IS NOT NULL) AS INTEGER) AS rejected FROM checked GROUP BY upload_id""", CHECKED)
def _(s):
    return validation.upload_status(checked(s))


@query("product_names", """
    SELECT user_id, sku, CASE WHEN product_name = '' THEN sku ELSE product_name END AS product_name FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, sku ORDER BY upload_id, row_no,
               CASE WHEN product_name = '' THEN sku ELSE product_name END) AS rn FROM checked WHERE field IS NULL)
    WHERE rn = 1""", CHECKED)
def _(s):
    return validation.product_names(checked(s))


@query("product_stats", """
    SELECT user_id, sku, CAST(count(*) AS INTEGER) AS sales_days, max(date) AS last_sale_date FROM silver GROUP BY 1, 2""")
def _(s):
    return validation.product_stats(s.silver_sales())


@query("day_bitmaps", """
    SELECT user_id, sku, CAST(count(DISTINCT date) AS INTEGER) AS sales_days, max(date) AS last_sale_date FROM sales_raw GROUP BY 1, 2""")
def _(s):
    """Days with sales, kept over three uploads, one of which comes twice."""
    path, sales = scratch_path(s.spark, "days"), s.stored("sales_days", lambda: s.sales_raw().select("user_id", "sku", "date"))
    for part in (0, 1, 2, 1):
        days.add_days(s.spark, sales.filter(F.pmod(F.xxhash64("date"), F.lit(3)) == part), path)
    return days.day_stats(s.spark.read.schema(days.DAYS).parquet(path))


@query("calendar_validate", """
    SELECT row_no, trim(label) AS label,
           CASE WHEN trim(label) = '' THEN 'label' WHEN s IS NULL THEN 'start_date' WHEN e IS NULL THEN 'end_date'
                WHEN e < s THEN 'end_date' END AS field,
           CASE WHEN trim(label) = '' THEN 'label is required' WHEN s IS NULL OR e IS NULL THEN 'must be ISO YYYY-MM-DD'
                WHEN e < s THEN 'end_date must be >= start_date' END AS message, s AS start_date, e AS end_date
    FROM (SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE o_orderpriority END AS label,
                 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS s,
                 CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END
                      WHEN o_orderkey % 5 = 0 THEN NULL
                      ELSE CAST(o_orderdate AS DATE) + CAST(o_custkey % 9 AS INTEGER) - 2 END AS e
          FROM orders)""")
def _(s):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = s.table("orders").select(
        k.alias("row_no"), F.when(k % 17 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("label"),
        F.when(k % 13 == 0, F.date_format(day, "yyyyMMdd")).otherwise(day.cast("string")).alias("start_date"),
        F.when(k % 7 == 0, "").when(k % 5 == 0, F.concat(F.substring(day.cast("string"), 1, 4), F.lit("-13-01")))
        .otherwise(F.date_add(day, (F.col("o_custkey") % 9).cast("int") - 2).cast("string")).alias("end_date"))
    return validation.validate_calendar(rows).select(
        "row_no", "label", "error.field", "error.message", "start_date", "end_date")


@query("profile_validate", """
    SELECT id, upper(cc) AS country_code, upper(cur) AS currency, concat_ws(',',
           CASE WHEN length(cc) <> 2 THEN 'country_code' END,
           CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'latitude' END,
           CASE WHEN lon NOT BETWEEN -180 AND 180 THEN 'longitude' END,
           CASE WHEN length(cur) <> 3 THEN 'currency' END) AS invalid
    FROM (SELECT c_custkey AS id, lower(substr(c_mktsegment, 1, CASE WHEN c_custkey % 10 = 0 THEN 3 ELSE 2 END)) AS cc,
                 lower(substr(c_mktsegment, 1, CASE WHEN c_custkey % 12 = 0 THEN 4 ELSE 3 END)) AS cur,
                 CASE WHEN c_custkey % 4 > 0 THEN c_acctbal / 100 END AS lat, c_acctbal / 40 AS lon FROM customer)""")
def _(s):
    k = F.col("c_custkey")
    rows = s.table("customer").select(
        k.alias("id"),
        F.lower(F.substring("c_mktsegment", F.lit(1), F.when(k % 10 == 0, 3).otherwise(2))).alias("country_code"),
        F.lower(F.substring("c_mktsegment", F.lit(1), F.when(k % 12 == 0, 4).otherwise(3))).alias("currency"),
        F.when(k % 4 > 0, F.col("c_acctbal") / 100).alias("latitude"), (F.col("c_acctbal") / 40).alias("longitude"))
    return validation.validate_profiles(rows).select(
        "id", "country_code", "currency", F.array_join("invalid", ",").alias("invalid"))


ASIN_SQL = {
    "existing": "SELECT user_id, asin FROM asins WHERE created_at % 7 = 0",
    "fresh": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, asin) AS rn
        FROM asins a WHERE regexp_full_match(asin, '[A-Z0-9]{10}')
        AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.user_id = a.user_id AND e.asin = a.asin)""",
    "have": "SELECT user_id, count(*) AS n FROM existing GROUP BY user_id",
}


@query("asin_validate", """
    SELECT a.user_id, a.asin, a.created_at,
           CASE WHEN NOT regexp_full_match(a.asin, '[A-Z0-9]{10}') THEN 'invalid'
                WHEN coalesce(h.n, 0) + (SELECT count(*) FROM fresh f WHERE f.user_id = a.user_id
                     AND f.created_at < a.created_at) >= 10 THEN 'cap_reached'
                WHEN e.asin IS NOT NULL THEN 'duplicate' ELSE 'accepted' END AS outcome
    FROM asins a LEFT JOIN have h USING (user_id) LEFT JOIN existing e ON e.user_id = a.user_id AND e.asin = a.asin
    """, ASIN_SQL)
def _(s):
    existing = s.asins().filter("created_at % 7 = 0").select("user_id", "asin")
    return validation.validate_asins(s.asins(), existing)


@query("batch_caps", """
    SELECT user_id, asin, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, asin)
           AS rn FROM asins) WHERE rn <= 10""")
def _(s):
    return top_n(s.asins(), ["user_id"], [F.col("created_at"), F.col("asin")], 10)


def _secret_sql() -> str:
    parts = []
    for name, pattern in scan.SECRET_PATTERNS.items():
        p = pattern.replace("'", "''")
        parts.append(f"""
            SELECT doc_id, '{name}' AS pattern, text, regexp_extract_all(text, '{p}') AS m,
                   string_split_regex(text, '{p}') AS pc FROM planted WHERE regexp_matches(text, '{p}')""")
    marks = " OR ".join(f"contains(context, '{w}')" for w in scan.HARMLESS)
    return f"""
        SELECT doc_id, pattern, CAST(st AS INTEGER) AS start, substr(trim(context), 1, 80) AS context FROM (
            SELECT *, substr(text, greatest(st - 60, 0) + 1, st + length(m[i]) + 20 - greatest(st - 60, 0)) AS context FROM (
                SELECT *, length(array_to_string(pc[1:i], '')) + coalesce(length(array_to_string(m[1:i - 1], '')), 0) AS st
                FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({' UNION ALL '.join(parts)}))))
        WHERE NOT ({marks})"""


# The documents hold none of the patterns, so texts get some written before, between and behind them.
PLANTED = {"planted": """
    SELECT doc_id, concat(CASE WHEN doc_id % 7 = 0 THEN concat('AKIA', lpad(CAST(doc_id AS VARCHAR), 16, '0'), ' ') ELSE '' END,
           text, CASE WHEN doc_id % 11 = 0 THEN ' see example: ' ELSE ' ' END,
           CASE WHEN doc_id % 5 = 0 THEN concat('password = "abcdefghijkl', doc_id, '" sk_live_', lpad(CAST(doc_id AS VARCHAR), 20, 'Z'))
                ELSE '' END,
           CASE WHEN doc_id % 13 = 0 THEN ' -----BEGIN RSA PRIVATE KEY-----' ELSE '' END) AS text FROM documents"""}


def planted(s):
    k = F.col("doc_id")
    number = k.cast("string")
    pair = F.concat(F.lit('password = "abcdefghijkl'), number, F.lit('" sk_live_'), F.lpad(number, 20, "Z"))
    return s.table("documents").select("doc_id", F.concat(
        F.when(k % 7 == 0, F.concat(F.lit("AKIA"), F.lpad(number, 16, "0"), F.lit(" "))).otherwise(""), "text",
        F.when(k % 11 == 0, " see example: ").otherwise(" "), F.when(k % 5 == 0, pair).otherwise(""),
        F.when(k % 13 == 0, " -----BEGIN RSA PRIVATE KEY-----").otherwise("")).alias("text"))


@query("secret_scan", _secret_sql(), PLANTED)
def _(s):
    return scan.secret_scan(planted(s))


HOSTS = [*scan.PAID_HOSTS, "example.net"]


@query("host_scan", " UNION ALL ".join(
    f"SELECT page_id, '{h}' AS host FROM pages WHERE contains(url, '{h}') OR contains(html, '{h}')" for h in HOSTS))
def _(s):
    return scan.host_scan(s.table("pages"), "page_id", "url", "html", hosts=HOSTS)
