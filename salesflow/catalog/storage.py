"""Queries: files and layer tables written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesflow.catalog.ingest import weather_messages
from salesflow.catalog.registry import query
from salesflow.operators import validation
from salesflow.schemas import SILVER_TRENDS, SILVER_WEATHER
from salesflow.session import scratch_path
from salesflow.sources import envelopes, files, layers

UPLOAD = ["date", "sku", "product_name", "quantity", "revenue", "price", "promo_flag"]


@query("envelope_scan", "SELECT user_id AS entity_key, date AS observed_at, CAST(k AS DOUBLE) AS precip_mm FROM signals")
def _(s):
    """Messages landed as text lines, read and parsed."""
    path = scratch_path(s.spark, "topic")
    weather_messages(s).select("value").write.text(path)
    rows = envelopes.parse_envelope(envelopes.read_envelope_files(s.spark, path))
    return rows.select("entity_key", "observed_at", F.get_json_object("payload", "$.precip_mm").cast("double").alias("precip_mm"))


@query("csv_sales_scan", """
    SELECT trim(date) AS date, trim(sku) AS sku, trim(product_name) AS product_name, trim(quantity) AS quantity,
           trim(revenue) AS revenue, trim(price) AS price, trim(promo_flag) AS promo_flag FROM upload_rows""")
def _(s):
    """Upload rows written as header files of upload size with odd header spelling, and read back by name."""
    path = scratch_path(s.spark, "csv")
    s.upload_rows().select(*[F.col(c).alias(f" {c.upper()} ") for c in reversed(UPLOAD)]).write.option(
        "maxRecordsPerFile", 20000).csv(path, header=True)
    rows, _ = files.read_sales_csv(s.spark, path)
    return rows.select(*[F.trim(c).alias(c) for c in UPLOAD])


@query("csv_header_check", """
    SELECT 1 AS row, 'header' AS field, 'Missing required columns: date, sku, product_name, quantity, revenue' AS message""")
def _(s):
    """The orders table as a sales file: every file lacks the contract columns."""
    path = scratch_path(s.spark, "csv")
    s.table("orders").select("o_orderkey", "o_orderpriority").write.csv(path, header=True)
    return files.read_sales_csv(s.spark, path)[1].select("row", "field", "message").distinct()


@query("calendar_csv_scan", """
    SELECT o_orderpriority AS label, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 3 AS end_date FROM orders""")
def _(s):
    path = scratch_path(s.spark, "csv")
    day = F.to_date("o_orderdate")
    s.table("orders").select(F.col("o_orderpriority").alias("label"), day.alias("start_date"),
                             F.date_add(day, 3).alias("end_date")).write.csv(path, header=True)
    rows, _ = files.read_calendar_csv(s.spark, path)
    return validation.validate_calendar(rows).filter("error is null").select("label", "start_date", "end_date")


ROWS_PER_FILE = 2000


@query("calendar_ics_scan", f"""
    SELECT CAST(seq // {ROWS_PER_FILE} AS BIGINT) AS upload_id, concat('day: ', k) AS label, date AS start_date,
           CASE WHEN k % 3 = 0 THEN date ELSE CAST(date + k % 5 AS DATE) END AS end_date
    FROM signals WHERE k % 7 > 1""")
def _(s):
    """Calendar files written and read back; some entries have no end, some no start or an empty one."""
    day = lambda d: F.date_format(d, "yyyyMMdd")
    k = F.col("k")
    lines = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("SUMMARY:day: "), k.cast("string")),
                        F.when(k % 7 == 1, F.lit("DTSTART:")).when(k % 7 > 1, F.concat(F.lit("DTSTART;VALUE=DATE:"), day(F.col("date")))),
                        F.when(k % 3 != 0, F.concat(F.lit("DTEND:"), day(F.date_add("date", k % 5 + 1)), F.lit("T000000Z"))),
                        F.lit("END:VEVENT"))
    bucket = F.floor(F.col("seq") / ROWS_PER_FILE).alias("upload_id")
    texts = s.signals().groupBy(bucket).agg(F.concat(
        F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.collect_list(lines), "\r\n"), F.lit("\r\nEND:VCALENDAR\r\n")).alias("value"))
    path = scratch_path(s.spark, "ics")
    texts.write.partitionBy("upload_id").text(path)
    rows, _ = files.read_calendar(s.spark, f"{path}/*")
    return validation.validate_calendar(rows).filter("error is null").select(
        F.regexp_extract("upload_id", "upload_id=([0-9]+)", 1).cast("bigint").alias("upload_id"), "label", "start_date", "end_date")


@query("csv_wide_scan", """
    SELECT trim(date) AS date, trim(sku) AS sku, trim(product_name) AS product_name, trim(quantity) AS quantity,
           trim(revenue) AS revenue, trim(price) AS price, trim(promo_flag) AS promo_flag FROM upload_rows""")
def _(s):
    """Upload rows behind forty other columns."""
    path = scratch_path(s.spark, "csv")
    s.upload_rows().select(*[F.lit(f"x{i}").alias(f"other{i}") for i in range(40)], *UPLOAD).write.option(
        "maxRecordsPerFile", 20000).csv(path, header=True)
    rows, _ = files.read_sales_csv(s.spark, path)
    return rows.select(*[F.trim(c).alias(c) for c in UPLOAD])


@query("bronze_append", """
    SELECT user_id AS entity_key, CAST(date_trunc('year', date) AS DATE) AS observed_at, count(*) * 2 AS rows FROM signals GROUP BY ALL""")
def _(s):
    """Two appends of the same messages; the table only grows."""
    path = scratch_path(s.spark, "bronze")
    rows = envelopes.parse_envelope(weather_messages(s)).withColumn("observed_at", F.trunc("observed_at", "year"))
    for _ in range(2):
        layers.append_bronze(rows, path)
    stored = s.spark.read.parquet(path)
    return stored.groupBy("entity_key", "observed_at").agg(F.count(F.lit(1)).alias("rows"))


@query("layer_overwrite", "SELECT user_id, date, temp_avg, precip_mm FROM weather")
def _(s):
    """A second write replaces the first."""
    path = scratch_path(s.spark, "layer")
    layers.overwrite_layer(s.weather().withColumn("temp_avg", F.lit(0.0)), path)
    layers.overwrite_layer(s.weather(), path)
    return layers.read_layer(s.spark, path, SILVER_WEATHER)


@query("medallion_scan", """
    SELECT user_id, date, interest FROM trends""")
def _(s):
    """A stored layer, and one never written, which reads as empty."""
    path = scratch_path(s.spark, "layer")
    layers.overwrite_layer(s.trends(), path)
    missing = layers.read_layer(s.spark, scratch_path(s.spark, "none"), SILVER_TRENDS)
    return layers.read_layer(s.spark, path, SILVER_TRENDS).unionByName(missing)
