import pytest
from pyspark.sql import functions as F

from rows import table
from salesflow.operators import health, merge
from salesflow.session import scratch_path
from salesflow.sources import layers


def now():
    return F.lit("2026-07-26 12:00:00").cast("timestamp")


@pytest.mark.parametrize("last, want", [("2026-07-26 11:30:00", "live"), ("2026-07-26 10:00:00", "stale"),
                                        ("2026-07-24 12:00:00", "degraded"), (None, "degraded")])
def test_status(frame, last, want):
    rows = frame([(1, last)], "i int, t timestamp")
    got = rows.select(health.status_of(F.col("t"), F.lit(1), F.lit(24), now()).alias("s"))
    assert got.first()["s"] == want


def test_latest_report_with_and_without_envelope(frame):
    rows = frame([('{"payload":{"source":"weather","status":"live"}}', "2026-07-01", 1),
                  ('{"signal":"weather","error":"boom"}', "2026-07-02", 2), ('{"status":"live"}', "2026-07-03", 3)],
                 "value string, reported_at timestamp, seq int")
    assert table(health.latest_health(rows), "signal", "status", "last_error") == [("weather", "degraded", "boom")]


RUNS = "source string, run_id string, ran_at timestamp, ok boolean"


def test_failed_feed_replays_its_last_good_rows(frame):
    runs = frame([("trends", "r1", "2026-07-20", True), ("trends", "r2", "2026-07-26", False),
                  ("events", "r1", "2026-07-01", True), ("events", "r2", "2026-07-26", False),
                  ("macro", "r1", "2026-07-26", True), ("weather", "r2", "2026-07-26", False)], RUNS)
    events = frame([("trends", "r1", 1), ("events", "r1", 2), ("macro", "r1", 3)], "source string, run_id string, v int")
    assert table(health.stale_fallback(events, runs, now()), "source", "v", "stale") == [("trends", 1, True)]


def test_replay_takes_the_last_run_that_published_and_stamps_anew(frame):
    runs = frame([("trends", "r1", "2026-07-20", True), ("trends", "r2", "2026-07-22", True), ("trends", "r3", "2026-07-26", False)], RUNS)
    events = frame([("trends", "r1", "2026-07-20", '{"v":1,"stale":true}')], "source string, run_id string, ingested_at timestamp, payload string")
    got = health.stale_fallback(events, runs, now())
    assert table(got, "run_id", "payload") == [("r1", '{"v":1,"stale":true}')]
    assert got.first()["ingested_at"] == got.select(now()).first()[0]


def test_stamp_inside_json(frame):
    rows = frame([('{"a":1}',), ("{}",), ("{ } ",)], "payload string")
    assert table(health.stale_stamp(rows)) == [('{ "stale":true}',), ('{"a":1,"stale":true}',), ('{"stale":true}',)]


def test_config(frame):
    profiles = frame([("a", "US", 1.0, 2.0, None), ("b", "IN", None, None, "Asia/Kolkata")],
                     "id string, country_code string, latitude double, longitude double, timezone string")
    settings = frame([("a", "weather", True), ("a", "macro", False), ("b", "trends", True)],
                     "user_id string, signal string, enabled boolean")
    products = frame([("a", "mugs "), ("a", "mugs"), ("b", "tees"), ("b", " ")], "user_id string, category string")
    got = health.producer_config(profiles, settings, products)
    assert table(got["enabled_signals"]) == [("trends",), ("weather",)]
    assert table(got["locations"]) == [("a", 1.0, 2.0, "UTC")]
    assert [r[0] for r in got["country_codes"].collect()] == ["IN", "US"]
    assert table(got["category_keywords"], "user_id", "keyword") == [("a", "mugs"), ("b", "tees")]
    gates = health.signal_gating(settings, profiles, products, frame([], "user_id string, asin string"))
    assert table(gates) == [("macro", False, False), ("trends", True, True), ("weather", True, True)]


def test_seeding_keeps_existing_toggles(frame):
    got = dict(table(health.seed_settings(frame([("a",)], "user_id string"),
                                          frame([("a", "weather", False)], "user_id string, signal string, enabled boolean")),
                     "signal", "enabled"))
    assert got == {"weather": False, "holidays": True, "trends": True, "macro": True, "events": True, "marketplace": False}


TARGET = "user_id string, sku string, qty double, source string"


def test_upsert_keeps_columns_the_update_lacks(frame):
    target = frame([("u", "A", 1.0, "csv"), ("u", "B", 2.0, "csv")], TARGET)
    updates = frame([("u", "A", 5.0, 1), ("u", "A", 6.0, 2), ("u", "C", None, 1)], "user_id string, sku string, qty double, n int")
    assert table(merge.upsert(target, updates, ["user_id", "sku"], ["n"])) == [
        ("u", "A", 6.0, "csv"), ("u", "B", 2.0, "csv"), ("u", "C", None, None)]


def test_update_and_delete(frame):
    target = frame([("u", "A", 1.0, "csv"), ("u", "B", 2.0, "csv")], TARGET)
    news = frame([("u", "B", 9.0), ("u", "Z", 9.0)], "user_id string, sku string, qty double")
    assert table(merge.update_by_key(target, news, ["user_id", "sku"], ["qty"]), "sku", "qty") == [("A", 1.0), ("B", 9.0)]
    assert table(merge.delete_by_key(target, news, ["user_id", "sku"]), "sku") == [("A",)]


def test_retention(frame):
    rows = frame([("nightly-20260701", "2026-07-01"), ("nightly-20260719", "2026-07-19"), ("nightly-20260726", "2026-07-26")],
                 "model_run_id string, generated_at timestamp")
    day = F.lit("2026-07-26").cast("date")
    assert merge.prune(rows, now(), "generated_at", 7).count() == 1
    assert merge.prune_runs(rows, day, 7).count() == 2


def test_newest_runs_per_tenant(frame):
    rows = frame([("u", f"r{i}", f"2026-07-{i:02d}") for i in range(1, 10) for _ in range(2)] + [("v", "r1", "2026-01-01")],
                 "user_id string, model_run_id string, generated_at timestamp")
    got = table(merge.keep_runs(rows, 7).select("user_id", "model_run_id").distinct())
    assert got == [("u", f"r{i}") for i in range(3, 10)] + [("v", "r1")]


def test_stored_upsert_touches_only_its_partitions_and_repeats_safely(spark, frame):
    path = scratch_path(spark, "table")
    rows = frame([("u", "A", "2026-07-01", 1.0), ("u", "A", "2026-07-02", 2.0)], "user_id string, sku string, date date, qty double")
    keys = ["user_id", "sku", "date"]
    merge.upsert_table(spark, path, rows, keys, "date")
    before = {r["p"] for r in spark.read.parquet(path).filter("date = '2026-07-01'").select(F.input_file_name().alias("p")).collect()}
    change = frame([("u", "A", "2026-07-02", 5.0), ("u", "B", "2026-07-02", 6.0)], "user_id string, sku string, date date, qty double")
    for _ in range(2):
        merge.upsert_table(spark, path, change, keys, "date")
    stored = spark.read.parquet(path)
    assert table(stored, "sku", "date", "qty") == [("A", "2026-07-01", 1.0), ("A", "2026-07-02", 5.0), ("B", "2026-07-02", 6.0)]
    after = {r["p"] for r in stored.filter("date = '2026-07-01'").select(F.input_file_name().alias("p")).collect()}
    assert before == after
    with pytest.raises(ValueError):
        merge.upsert_table(spark, path, change, ["user_id"], "date")


def test_layers(spark, frame):
    path = scratch_path(spark, "layer")
    schema = "user_id string, date date, interest double"
    assert layers.read_layer(spark, path, schema).count() == 0
    layers.overwrite_layer(frame([], schema), path)
    assert not layers.exists(spark, path)
    layers.overwrite_layer(frame([("u", "2026-07-01", 1.0)], schema), path)
    layers.overwrite_layer(frame([("u", "2026-07-02", 2.0)], schema), path)
    assert table(layers.read_layer(spark, path, schema)) == [("u", "2026-07-02", 2.0)]


def test_bronze_is_appended_and_pruned_by_day(spark, frame):
    path = scratch_path(spark, "bronze")
    rows = frame([("weather", "2026-07-01"), ("weather", "2025-01-01")], "source string, observed_at date")
    layers.append_bronze(rows, path)
    layers.append_bronze(rows, path)
    recent = layers.lookback(spark.read.parquet(path), F.lit("2026-07-26").cast("date"), 400, "observed_date")
    assert recent.count() == 2
    assert "PartitionFilters: [isnotnull(observed_date" in recent._jdf.queryExecution().executedPlan().toString()


def test_run_report(frame):
    runs = frame([("trends", "r1", "2026-07-26", True, "2026-07-26", None), ("macro", "r1", "2026-07-26", False, None, "boom")],
                 "source string, run_id string, ran_at timestamp, ok boolean, last_success_at timestamp, error string")
    events = frame([("trends", "r1", False), ("macro", "r1", True)], "source string, run_id string, stale boolean")
    assert table(health.run_report(runs, events, now())) == [
        ("macro", "r1", 1, True, "stale", "boom"), ("trends", "r1", 1, False, "live", None)]
