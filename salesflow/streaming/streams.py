"""Incremental ingest: Bronze append, deduplication, daily counts, health table and sales events."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from salesflow.operators.keyed import latest, top_n
from salesflow.operators.validation import cleaned_sales, error_rows, row_limit_error, valid_sales, with_errors
from salesflow.sources.envelopes import parse_envelope, route, to_envelope
from salesflow.sources.folders import exists, names_in, remove
from salesflow.streaming.views import apply_once, merge_versions


def envelope_stream(spark: SparkSession, path: str | None = None, **kafka: str) -> DataFrame:
    """Messages as a stream: landed JSON lines, or a topic where the connector is deployed."""
    if path:
        return spark.readStream.text(path)
    return spark.readStream.format("kafka").options(**kafka).load().select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "offset")


def run_available(df: DataFrame, out: str, checkpoint: str, partition: str | None = None,
                  mode: str = "append") -> StreamingQuery:
    """Write what has arrived since the last run, then stop."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if partition:
        writer = writer.partitionBy(partition)
    return writer.format("parquet").start(out)


def stream_bronze(messages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each message once into the Bronze table, one folder per observed day."""
    rows = parse_envelope(messages).withColumn("observed_date", F.col("observed_at"))
    return run_available(rows, out, checkpoint, "observed_date")


def stream_dedupe(events: DataFrame, keys: list[str], time: str = "ingested_at", delay: str = "1 day") -> DataFrame:
    """First copy of each key while the watermark remembers it.

    This bounds what republishing adds; ``stream_versions`` remembers all keys and keeps the newest copy.
    """
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_events_daily(events: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Local events per tenant and day, emitted when the day can no longer change.

    Later rows and days still open are left out; ``stream_daily_counts`` has them all.
    """
    counted = events.withWatermark(time, delay).groupBy("user_id", F.window(time, "1 day").alias("_day")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.coalesce("large_venue", F.lit(False))).alias("large_event_count"))
    return counted.select("user_id", F.to_date("_day.start").alias("date"), "event_count", "large_event_count")


def stream_daily_counts(events: DataFrame, table: str, checkpoint: str, time: str = "ts") -> StreamingQuery:
    """Local events per tenant and day in ``table``, one folder per day, with days still open and rows however late.

    A batch is counted by itself and its counts are added once to the days it names (``views.apply_once``); earlier rows are not
    read again.
    """

    def store(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy("user_id", F.to_date(time).alias("date")).agg(
            F.count(F.lit(1)).alias("event_count"), F.count_if(F.coalesce("large_venue", F.lit(False))).alias("large_event_count"))
        apply_once(counted, number, table, ["user_id"], "date")

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_versions(events: DataFrame, store: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """The newest version of every key in ``store`` (``views.merge_versions``), however long ago its first copy came."""
    return events.writeStream.foreachBatch(lambda batch, _: merge_versions(batch, store, keys, order)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_health(reports: DataFrame, table: str) -> None:
    """Newest report per signal of the stored table and ``reports``; repeating a batch changes nothing.

    The table has one row, and one folder, per signal.
    """
    spark = reports.sparkSession
    rows = latest(reports, ["signal"], ["reported_at"])
    if exists(spark, table):
        stored = spark.read.schema(reports.schema).parquet(table).select(*reports.columns)
        rows = latest(stored.unionByName(rows), ["signal"], ["reported_at"])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("signal").parquet(table)


def stream_health(reports: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the current status per signal from a stream of (signal, status, ..., reported_at)."""
    return reports.writeStream.foreachBatch(lambda batch, _: merge_health(batch, table)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_route(messages: DataFrame, events_out: str, health_table: str, checkpoint: str) -> StreamingQuery:
    """Health messages to the status table, everything else to the event table.

    Events of a batch go to a folder of that batch, so a repeated batch replaces itself.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        events, reports = route(batch)
        events.write.mode("overwrite").parquet(f"{events_out}/batch={number}")
        body = F.coalesce(F.get_json_object("value", "$.payload"), F.col("value"))
        field = lambda name: F.get_json_object(body, f"$.{name}")
        merge_health(reports.select(
            F.coalesce(field("source"), F.col("key")).alias("signal"),
            F.coalesce(field("status"), F.lit("degraded")).alias("status"),
            field("last_success_at").alias("last_success_at"), field("error").alias("last_error"),
            F.coalesce(field("reported_at"), F.lit("")).alias("reported_at")), health_table)
        batch.unpersist()

    return messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


FORGET_AFTER = 7  # days: an upload without rows for so long is over
UPLOAD_STATE = "upload_id string, skus array<string>, beyond boolean, arrived date, batch bigint"


def limit_uploads(rows: DataFrame, number: int, state: str, max_rows: int | None, max_skus: int | None) -> DataFrame:
    """Rows of a batch with ``_allowed`` (NULL: the SKU is beyond the limit) and ``_beyond`` (the row is beyond the row limit).

    The SKUs an upload has been granted, in order of appearance, and whether its row limit has been reported are kept under
    ``state``, a folder per day and batch, with one row for each upload of the batch; the newest row of an upload holds. Of the rows
    beyond the row limit the first one is given, once. SKUs of one batch appear in the order of row numbers. A batch that comes
    again sees what it saw and writes the same; folders that no upload needs any more are removed.
    """
    spark = rows.sparkSession
    today = date.today()
    oldest = (today - timedelta(days=FORGET_AFTER)).isoformat()
    none = F.array().cast("array<string>")
    over = F.lit(False) if max_rows is None else F.col("row_no") - 1 > max_rows
    each = rows.groupBy("upload_id").agg(F.coalesce(F.bool_or(over), F.lit(False)).alias("_over"))
    if exists(spark, state):
        stored = spark.read.schema(UPLOAD_STATE).parquet(state).filter((F.col("arrived") >= F.lit(oldest)) & (F.col("batch") < number))
        known = stored.groupBy("upload_id").agg(F.max(F.struct("batch", "skus", "beyond")).alias("_s")).select(
            "upload_id", F.col("_s.skus").alias("_had"), F.col("_s.beyond").alias("_reported"))
        each = each.join(known, "upload_id", "left").withColumns({
            "_had": F.coalesce("_had", none), "_reported": F.coalesce("_reported", F.lit(False))})
    else:
        each = each.withColumns({"_had": none, "_reported": F.lit(False)})
    if max_skus is not None:
        seen = rows.filter(~over & (F.col("sku") != "")).groupBy("upload_id", "sku").agg(F.min("row_no").alias("_first"))
        fresh = seen.join(each.select("upload_id", "_had"), "upload_id").filter(~F.array_contains("_had", F.col("sku")))
        first = top_n(fresh.drop("_had"), ["upload_id"], [F.col("_first"), F.col("sku")], max_skus, position="_at")
        lists = first.groupBy("upload_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_at", "sku"))), lambda x: x["sku"]).alias("_new"))
        each = each.join(lists, "upload_id", "left").withColumn(
            "_had", F.slice(F.concat("_had", F.coalesce("_new", none)), 1, max_skus))
    folder = f"{state}/arrived={today.isoformat()}/batch={number}"
    each.select("upload_id", F.col("_had").alias("skus"), (F.col("_reported") | F.col("_over")).alias("beyond"), "_reported").write.mode(
        "overwrite").parquet(folder)
    for name in names_in(spark, state):
        if name.startswith("arrived=") and name < f"arrived={oldest}":
            remove(spark, f"{state}/{name}")
    now = spark.read.schema("upload_id string, skus array<string>, _reported boolean").parquet(folder)
    joined = rows.join(now, "upload_id", "left")
    allowed = F.lit(True) if max_skus is None else F.when(F.array_contains("skus", F.col("sku")), True)
    within = joined.filter(~over).select(*rows.columns, allowed.alias("_allowed"), F.lit(False).alias("_beyond"))
    if max_rows is None:
        return within
    first = joined.filter(over & ~F.coalesce("_reported", F.lit(False))).groupBy("upload_id").agg(
        F.min_by(F.struct(*[c for c in rows.columns if c != "upload_id"]), "row_no").alias("_r"))
    return within.unionByName(first.select(
        "upload_id", *[f"_r.{c}" for c in rows.columns if c != "upload_id"], F.lit(True).alias("_allowed"), F.lit(True).alias("_beyond")))


def stream_sales_events(rows: DataFrame, out: str, checkpoint: str, ingested_at: Column, max_rows: int | None = None,
                        max_skus: int | None = None, errors_out: str | None = None) -> StreamingQuery:
    """Valid rows of arriving uploads as sales messages keyed by tenant and SKU, and to ``errors_out`` what ``error_rows`` has.

    An upload may arrive in parts; its limits hold for the whole of it (``limit_uploads``, whose state is beside the stream's own in
    ``checkpoint``). ``ingested_at`` stamps the messages, and both outputs have a folder per batch, so that a repeated batch writes
    the same. Messages repeat their field names on every line, so they are written compressed.
    """
    rows = cleaned_sales(rows)
    limited = max_rows is not None or max_skus is not None

    def store(batch: DataFrame, number: int) -> None:
        if limited:
            over = F.col("_beyond")
            judged = with_errors(limit_uploads(batch, number, f"{checkpoint}/uploads", max_rows, max_skus), max_skus).withColumn(
                "error", F.when(over, row_limit_error(F.col("row_no"), max_rows)).otherwise(F.col("error"))).drop("_beyond")
        else:
            judged = with_errors(batch.withColumn("_allowed", F.lit(True)), None)
        if errors_out:
            judged.persist()
        messages = to_envelope(valid_sales(judged), "sales_csv", ["user_id", "sku"],
                               ["user_id", "upload_id", "sku", "date", "quantity", "revenue", "price", "promo_flag"],
                               "date", ingested_at)
        messages.write.mode("overwrite").option("compression", "gzip").json(f"{out}/batch={number}")
        if errors_out:
            error_rows(judged).write.mode("overwrite").parquet(f"{errors_out}/batch={number}")
        judged.unpersist()

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
