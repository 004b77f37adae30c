import json
import random

from pyspark.sql import functions as F

from rows import table
from salesflow.operators.validation import error_rows, valid_sales, validate_sales
from salesflow.session import scratch_path
from salesflow.sources.folders import names_in
from salesflow.streaming import streams
from salesflow.streaming.views import versions


def land(folder, name, messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(m) for m in messages) + "\n")


def message(key, day="2026-07-01", **payload):
    return {"source": "events", "entity_key": key, "observed_at": day, "ingested_at": f"{day}T10:00:00Z", "schema_version": 1,
            "payload": payload}


def test_bronze_takes_each_message_once(spark, tmp_path):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    land(tmp_path / "in", "a.json", [message("k1"), message("k2", "2026-07-02")])
    for name in ("b.json", None):
        streams.stream_bronze(streams.envelope_stream(spark, str(tmp_path / "in")), out, state).awaitTermination()
        if name:
            land(tmp_path / "in", name, [message("k3")])
    assert table(spark.read.parquet(out), "entity_key") == [("k1",), ("k2",), ("k3",)]


def test_days_close_behind_the_watermark(spark, tmp_path):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    schema = "user_id string, ts timestamp, large_venue boolean"
    rows = [{"user_id": "u1", "ts": f"2026-07-{d:02d}T05:00:00Z", "large_venue": d % 2 == 0} for d in (1, 1, 2, 5)]
    land(tmp_path / "in", "a.json", rows)
    events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    streams.run_available(streams.stream_events_daily(events), out, state).awaitTermination()
    assert table(spark.read.parquet(out)) == [("u1", "2026-07-01", 2, 0), ("u1", "2026-07-02", 1, 1)]


def test_daily_counts_hold_late_and_open_days(spark, tmp_path):
    out, state = (scratch_path(spark, x) for x in ("out", "state"))
    schema = "user_id string, ts timestamp, large_venue boolean"
    for i, days in enumerate([(1, 1, 2, 20), (1, 20, 3)]):
        land(tmp_path / "in", f"{i}.json", [{"user_id": "u1", "ts": f"2026-07-{d:02d}T05:00:00Z", "large_venue": d % 2 == 0} for d in days])
        events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        streams.stream_daily_counts(events, out, state).awaitTermination()
    assert table(spark.read.parquet(out), "user_id", "date", "event_count", "large_event_count") == [
        ("u1", "2026-07-01", 3, 0), ("u1", "2026-07-02", 1, 1), ("u1", "2026-07-03", 1, 0), ("u1", "2026-07-20", 2, 2)]


def test_copies_are_dropped_across_batches(spark, tmp_path):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    for name in ("a.json", "b.json"):
        land(tmp_path / "in", name, [{"k": "x", "ingested_at": "2026-07-01T05:00:00Z"}])
        events = spark.readStream.schema("k string, ingested_at timestamp").json(str(tmp_path / "in"))
        streams.run_available(streams.stream_dedupe(events, ["k"]), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_versions_of_a_key_arrive_over_runs(spark, tmp_path):
    store, state = scratch_path(spark, "store"), scratch_path(spark, "state")
    schema = "k string, ingested_at timestamp, v int"
    for i, (day, v) in enumerate([("2026-07-01", 1), ("2026-07-11", 2), ("2026-06-01", 0)]):
        land(tmp_path / "in", f"{i}.json", [{"k": "x", "ingested_at": f"{day}T05:00:00Z", "v": v}, {"k": f"only {i}", "ingested_at": f"{day}T05:00:00Z", "v": v}])
        events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        streams.stream_versions(events, store, state, ["k"], ["ingested_at"]).awaitTermination()
    assert table(versions(spark, store, schema), "k", "v") == [("only 0", 1), ("only 1", 2), ("only 2", 0), ("x", 2)]


NAMES = ["upload_id", "user_id", "row_no", "date", "sku", "product_name", "quantity", "revenue", "price", "promo_flag"]


def upload(seed):
    """Rows of some uploads with faults, blank SKUs and SKUs that come back."""
    rnd, rows = random.Random(seed), []
    for u in range(5):
        for n in range(2, rnd.randint(6, 26)):
            rows.append([f"up{u}", "u1", n, rnd.choice(["2026-07-01", "bad"]), rnd.choice(["A", " B", "C ", "D", "E", " "]), "Mug",
                         rnd.choice(["3", "-1", "x"]), "9", "", rnd.choice(["", "yes", "maybe"])])
    return rows


def test_an_upload_in_four_parts_has_the_errors_of_the_whole(spark, tmp_path):
    schema = ", ".join(f"{n} {'int' if n == 'row_no' else 'string'}" for n in NAMES)
    for limits in ((12, 3), (None, 2), (15, None)):
        rows, out, errors, state = upload(limits[0] or 1), scratch_path(spark, "out"), scratch_path(spark, "errors"), scratch_path(spark, "state")
        folder = tmp_path / f"in{limits}"
        for part in range(4):
            land(folder, f"{part}.json", [dict(zip(NAMES, r)) for r in rows if min((r[2] - 2) // 5, 3) == part])
            arriving = spark.readStream.schema(schema).json(str(folder))
            streams.stream_sales_events(arriving, out, state, F.lit("2026-07-02").cast("timestamp"), *limits, errors).awaitTermination()
        whole = validate_sales(spark.createDataFrame(rows, schema), *limits)
        assert table(spark.read.parquet(errors), "upload_id", "row", "field", "message") == table(error_rows(whole))
        assert spark.read.json(out).count() == valid_sales(whole).count()


def test_upload_limits_take_no_python_and_a_repeated_batch_is_judged_the_same(spark):
    state = scratch_path(spark, "uploads")
    batches = [[("u", 2, "A"), ("u", 3, "B"), ("v", 2, "C")], [("u", 4, "C"), ("u", 5, "A"), ("u", 9, "B"), ("v", 3, "D")]]
    frames = [spark.createDataFrame(b, "upload_id string, row_no int, sku string") for b in batches]
    judge = lambda n: streams.limit_uploads(frames[n], n, state, 6, 2)
    shown = lambda df: table(df, "upload_id", "row_no", "_allowed", "_beyond")
    assert shown(judge(0)) == [("u", 2, True, False), ("u", 3, True, False), ("v", 2, True, False)]
    second = judge(1)
    assert "Python" not in second._jdf.queryExecution().toString() and "Pandas" not in second._jdf.queryExecution().toString()
    want = shown(second)
    assert want == [("u", 4, None, False), ("u", 5, True, False), ("u", 9, True, True), ("v", 3, True, False)]
    assert shown(judge(1)) == want
    spark.range(1).write.parquet(f"{state}/arrived=2020-01-01/batch=0")
    assert shown(judge(1)) == want and not any("2020" in n for n in names_in(spark, state))


def test_health_keeps_the_newest_report(spark, tmp_path):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    schema = "signal string, status string, reported_at timestamp"
    batches = [[("weather", "live", "2026-07-02"), ("macro", "live", "2026-07-01")], [("weather", "stale", "2026-07-01")],
               [("macro", "degraded", "2026-07-05")]]
    for i, batch in enumerate(batches):
        land(tmp_path / "in", f"{i}.json", [dict(zip(("signal", "status", "reported_at"), r)) for r in batch])
        reports = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        streams.stream_health(reports, out, state).awaitTermination()
    assert table(spark.read.parquet(out), "signal", "status") == [("macro", "degraded"), ("weather", "live")]


def test_routing_stores_events_and_health(spark, tmp_path):
    events, health, state = (scratch_path(spark, n) for n in ("events", "health", "state"))
    land(tmp_path / "in", "a.json", [
        {"topic": "signals.events", "key": "k", "value": json.dumps(message("k1", a=1))},
        {"topic": "signals.health", "key": "w", "value": json.dumps({"source": "weather", "status": "live", "reported_at": "2026-07-01"})},
        {"topic": "signals.health", "key": "w", "value": json.dumps({"source": "weather", "status": "stale", "reported_at": "2026-07-02"})}])
    messages = spark.readStream.schema("topic string, key string, value string").json(str(tmp_path / "in"))
    streams.stream_route(messages, events, health, state).awaitTermination()
    assert table(spark.read.parquet(events), "entity_key", "payload") == [("k1", '{"a":1}')]
    assert table(spark.read.parquet(health), "signal", "status") == [("weather", "stale")]


def test_valid_sales_rows_become_messages(spark, tmp_path):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    names = ["upload_id", "user_id", "row_no", "date", "sku", "product_name", "quantity", "revenue", "price", "promo_flag"]
    rows = [["f", "u1", 2, "2026-07-01", "A", "Mug", "3", "9", "", ""], ["f", "u1", 3, "bad", "A", "Mug", "3", "9", "", ""]]
    land(tmp_path / "in", "a.json", [dict(zip(names, r)) for r in rows])
    schema = ", ".join(f"{n} {'int' if n == 'row_no' else 'string'}" for n in names)
    streams.stream_sales_events(spark.readStream.schema(schema).json(str(tmp_path / "in")), out, state,
                                F.lit("2026-07-02").cast("timestamp")).awaitTermination()
    got = spark.read.json(out).select("key", F.get_json_object("value", "$.payload.quantity").cast("double").alias("q")).collect()
    assert [(r["key"], r["q"]) for r in got] == [("u1:A", 3.0)]


def test_messages_are_written_compressed(spark, tmp_path):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    land(tmp_path / "in", "a.json", [dict(zip(NAMES, ["f", "u1", 2, "2026-07-01", "A", "Mug", "3", "9", "", ""]))])
    schema = ", ".join(f"{n} {'int' if n == 'row_no' else 'string'}" for n in NAMES)
    arriving = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    streams.stream_sales_events(arriving, out, state, F.lit("2026-07-02").cast("timestamp")).awaitTermination()
    parts = [n for n in names_in(spark, f"{out}/batch=0") if n.startswith("part-")]
    assert parts and all(n.endswith(".json.gz") for n in parts) and spark.read.json(out).count() == 1
