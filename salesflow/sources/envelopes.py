"""Message envelopes: read, parse, split by source, build and route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesflow.functions.scalars import entity_key
from salesflow.schemas import PAYLOADS

HEALTH_TOPIC = "signals.health"


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """All messages of a topic (needs the connector on the classpath)."""
    raw = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp"),
                      F.col("offset").alias("seq"))


def read_envelope_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed messages, one JSON text per line."""
    return spark.read.text(path)


FIELDS = ["source", "entity_key", "observed_at", "ingested_at", "schema_version", "payload"]


def parse_envelope(df: DataFrame, body: str = "value", keep: list[str] | None = None) -> DataFrame:
    """The six envelope fields from one pass over the text; the payload stays text."""
    kept = df.select(F.json_tuple(body, *FIELDS).alias(*[f"_{f}" for f in FIELDS]), *(keep or []))
    names = [c for c in kept.columns if c not in {f"_{f}" for f in FIELDS}]
    return kept.select(
        F.col("_source").alias("source"), F.col("_entity_key").alias("entity_key"),
        F.col("_observed_at").try_cast("date").alias("observed_at"),
        F.col("_ingested_at").try_cast("timestamp").alias("ingested_at"),
        F.col("_schema_version").try_cast("int").alias("schema_version"), F.col("_payload").alias("payload"), *names)


def payloads(envelopes: DataFrame, source: str, keep: list[str] | None = None) -> DataFrame:
    """Typed payload of one source with its observed day and ingest time."""
    typed = envelopes.filter(F.col("source") == source).withColumn("_p", F.from_json("payload", PAYLOADS[source]))
    return typed.select("_p.*", F.col("observed_at").alias("date") if source != "sales_csv" else F.col("observed_at"),
                        "ingested_at", *(keep or []))


def split_signals(envelopes: DataFrame, keep: list[str] | None = None) -> dict[str, DataFrame]:
    """One typed table per signal source."""
    return {source: payloads(envelopes, source, keep)
            for source in ("weather", "holidays", "trends", "macro", "events", "marketplace")}


def to_envelope(df: DataFrame, source: str, key_columns: list[str], payload_columns: list[str], observed_at: str,
                ingested_at: Column) -> DataFrame:
    """(key, value) messages with the row as payload."""
    key = entity_key(*[F.col(c).cast("string") for c in key_columns])
    body = F.struct(
        F.lit(source).alias("source"), key.alias("entity_key"), F.col(observed_at).cast("string").alias("observed_at"),
        F.date_format(ingested_at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ingested_at"), F.lit(1).alias("schema_version"),
        F.struct(*payload_columns).alias("payload"))
    return df.select(key.alias("key"), F.to_json(body).alias("value"))


def route(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signal events to append, and health reports to upsert, from (topic, key, value) messages."""
    is_health = F.col("topic") == HEALTH_TOPIC
    body = parse_envelope(messages, "value", ["topic", "key", F.col("value").alias("_raw")])
    events = body.filter(~is_health).select(
        F.coalesce("source", "topic").alias("source"), F.coalesce("entity_key", "key").alias("entity_key"),
        "observed_at", F.coalesce("payload", "_raw").alias("payload"))
    return events, messages.filter(is_health)
