"""Tables that batches keep up to date, runs that become visible as a whole, and retention by zones."""

import random

import pytest
from pyspark.sql import functions as F

from rows import table
from salesflow.operators import zones
from salesflow.plans import serving, serving_tables
from salesflow.schemas import FORECASTS
from salesflow.session import scratch_path
from salesflow.sources import snapshots
from salesflow.sources.folders import exists, names_in
from salesflow.streaming import views

COUNTS = "user_id string, date date, event_count bigint, large_event_count bigint"


def scans(df):
    """Metrics of the file scans of a DataFrame after it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name.startswith("FileSourceScan"):
            found.append({k: node.metrics().get(k).get().value() for k in ("numFiles", "numOutputRows")})
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def counts(df):
    return table(df.select("user_id", "date", "event_count", "large_event_count"))


def test_batches_out_of_order_and_twice_are_counted_once(spark, frame):
    path = scratch_path(spark, "counts")
    batches = {2: [("u1", "2026-07-01", 2, 1), ("u2", "2026-07-09", 1, 0)], 0: [("u1", "2026-07-01", 5, 0), (None, "2026-07-02", 1, 1)],
               1: [("u1", "2026-07-02", 4, 4), ("u2", "2026-07-01", 3, 0)]}
    for number in (2, 0, 1, 0, 2):
        views.apply_once(frame(batches[number], COUNTS), number, path, ["user_id"], "date")
    stored = spark.read.parquet(path)
    assert counts(stored) == [("u1", "2026-07-01", 7, 1), ("u1", "2026-07-02", 4, 4), ("u2", "2026-07-01", 3, 0), ("u2", "2026-07-09", 1, 0),
                              (None, "2026-07-02", 1, 1)]
    assert {(r.user_id, str(r.date)): r.batches for r in stored.collect()}[("u1", "2026-07-01")] == [0, 2]


def test_a_batch_touches_the_folders_of_its_days_only(spark, frame):
    path = scratch_path(spark, "counts")
    views.apply_once(frame([("u1", f"2026-07-{d:02d}", 1, 0) for d in range(1, 29)], COUNTS), 0, path, ["user_id"], "date")
    before = {n: names_in(spark, f"{path}/{n}") for n in names_in(spark, path)}
    views.apply_once(frame([("u9", "2026-07-03", 1, 0), ("u1", "2026-07-04", 1, 0)], COUNTS), 1, path, ["user_id"], "date")
    changed = {n for n, files in before.items() if names_in(spark, f"{path}/{n}") != files and n.startswith("date=")}
    assert changed == {"date=2026-07-03", "date=2026-07-04"}
    batch = frame([("u1", "2026-07-04", 1, 0)], COUNTS)
    assert scans(views.of_days(spark.read.parquet(path), batch, "date").filter("event_count > 0"))[0]["numFiles"] == 1
    # A batch that was cut off between two folders: the first holds it, the second does not yet.
    views.apply_once(frame([("u1", "2026-07-05", 1, 0)], COUNTS), 2, path, ["user_id"], "date")
    views.apply_once(frame([("u1", "2026-07-05", 1, 0), ("u1", "2026-07-06", 1, 0)], COUNTS), 2, path, ["user_id"], "date")
    got = dict((str(r.date), r.event_count) for r in spark.read.parquet(path).filter("user_id = 'u1'").collect())
    assert (got["2026-07-05"], got["2026-07-06"]) == (2, 2)


EVENTS = "k string, sent timestamp, body string"


def test_the_newest_version_of_a_key_stays_however_late(spark, frame):
    store, rnd, newest = scratch_path(spark, "versions"), random.Random(3), {}
    for step in range(6):
        batch = [(f"k{rnd.randrange(40)}", f"2026-07-{rnd.randint(1, 28):02d} 00:00:00", f"b{step}-{i}") for i in range(25)]
        for k, sent, body in batch:
            newest[k] = max(newest.get(k, ("", "")), (sent, body))
        for _ in range(1 + step % 2):  # some batches come twice
            views.merge_versions(frame(batch, EVENTS), store, ["k"], ["sent", "body"], buckets=4, slots=2)
    got = views.versions(spark, store, EVENTS).collect()
    assert len(got) == len(newest) and {r.k: r.body for r in got} == {k: v[1] for k, v in newest.items()}


def test_copies_ten_days_apart_leave_the_newest(spark, frame):
    store = scratch_path(spark, "versions")
    for sent, body in (("2026-07-01 00:00:00", "old"), ("2026-07-11 00:00:00", "new"), ("2026-06-01 00:00:00", "older")):
        views.merge_versions(frame([("x", sent, body)], EVENTS), store, ["k"], ["sent"])
    assert table(views.versions(spark, store, EVENTS), "k", "body") == [("x", "new")]


def test_buckets_with_new_keys_only_are_not_read(spark, frame):
    store = scratch_path(spark, "versions")
    views.merge_versions(frame([("a", "2026-07-01 00:00:00", "1")], EVENTS), store, ["k"], ["sent"], buckets=1, slots=4)
    first = names_in(spark, f"{store}/rows/bucket=0")
    views.merge_versions(frame([("b", "2026-07-01 00:00:00", "1")], EVENTS), store, ["k"], ["sent"], buckets=1, slots=4)
    both = names_in(spark, f"{store}/rows/bucket=0")
    assert set(first) < set(both)  # added to
    views.merge_versions(frame([("a", "2026-07-02 00:00:00", "2")], EVENTS), store, ["k"], ["sent"], buckets=1, slots=4)
    assert not set(names_in(spark, f"{store}/rows/bucket=0")) & {n for n in both if n.endswith(".parquet")}  # rewritten
    assert views.versions(spark, store, EVENTS).count() == 2


def test_a_batch_cut_off_after_its_filters_is_merged_when_it_comes_again(spark, frame):
    store, batch = scratch_path(spark, "versions"), frame([("a", "2026-07-01 00:00:00", "1")], EVENTS)
    marks = views.placed(batch, ["k"], 4, 2).groupBy("bucket", "slot").agg(F.bitmap_construct_agg("bit").alias("marks"))
    marks.write.partitionBy("bucket").parquet(f"{store}/filters")
    for _ in range(2):
        views.merge_versions(batch, store, ["k"], ["sent"], buckets=4, slots=2)
    assert views.versions(spark, store, EVENTS).count() == 1


def tables(spark, run, users=("u1",), yhat=1.0, skus=("A", "B")):
    day = f"{run[8:12]}-{run[12:14]}-{run[14:]}"
    rows = [(u, s, d, run, "boosted:1", yhat + d % 3, 0.0, 9.0, 5.0) for u in users for s in skus for d in range(30)]
    forecasts = spark.createDataFrame(rows, "user_id string, sku string, d int, model_run_id string, model_version string, yhat double, "
                                            "yhat_lower double, yhat_upper double, mape_backtest double").select(
        "user_id", "sku", F.expr(f"date_add(date '{day}', d + 1)").alias("forecast_date"), "model_run_id", "model_version",
        *[F.col(c).cast("decimal(14, 2)").alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")],
        F.col("mape_backtest").cast("decimal(6, 2)").alias("mape_backtest"), F.expr(f"timestamp '{day} 00:00:00'").alias("generated_at"))
    factors = spark.createDataFrame([(u, s, run, f"f{i}", "up", i / 10) for u in users for s in skus for i in range(7)],
                                    "user_id string, sku string, model_run_id string, factor string, direction string, importance double")
    factors = factors.select("user_id", "sku", "model_run_id", "factor", F.col("importance").cast("decimal(6, 4)").alias("importance"), "direction")
    return forecasts, factors


def written(spark, root, run, **options):
    return snapshots.write_run(spark, root, run, run, serving_tables.run_tables(*tables(spark, run, **options)))


def test_a_run_is_visible_whole_or_not_at_all(spark):
    root = scratch_path(spark, "runs")
    assert snapshots.current(spark, root).runs == () and serving_tables.stored(spark, root, "forecasts").count() == 0
    snapshots.publish(spark, root, written(spark, root, "nightly-20260701"))

    def fails(path):
        raise RuntimeError("cut off")

    parts = {**serving_tables.run_tables(*tables(spark, "nightly-20260702")), "gold_model_metrics": fails}
    with pytest.raises(RuntimeError):
        snapshots.write_run(spark, root, "nightly-20260702", "nightly-20260702", parts)
    assert table(serving_tables.stored(spark, root, "forecasts").select("model_run_id").distinct()) == [("nightly-20260701",)]
    held = snapshots.current(spark, root)
    again = written(spark, root, "nightly-20260701", yhat=7.0)
    assert snapshots.current(spark, root) == held  # written, not visible
    snapshots.publish(spark, root, again)
    snapshots.publish(spark, root, written(spark, root, "nightly-20260702"))
    now = serving_tables.stored(spark, root, "forecasts")
    assert now.count() == 120 and now.filter("model_run_id = 'nightly-20260701'").agg(F.min("yhat")).first()[0] == 7
    # A reader that began before still has what it saw; vacuum keeps the folders of the newest manifests.
    assert held.table(spark, root, "forecasts", FORECASTS).agg(F.min("yhat")).first()[0] == 1
    snapshots.prune(spark, root, "nightly-20260702")
    assert [r.id for r in snapshots.current(spark, root).runs] == ["nightly-20260702"]
    assert snapshots.prune(spark, root, "nightly-20260702").version == snapshots.current(spark, root).version
    gone = snapshots.vacuum(spark, root, 1)
    assert len(gone) == 3 and len(names_in(spark, f"{root}/runs")) == 1 and len(names_in(spark, f"{root}/manifests")) <= 2
    assert serving_tables.stored(spark, root, "forecasts").count() == 60


def test_two_writers_do_not_lose_a_run(spark, monkeypatch):
    root = scratch_path(spark, "runs")
    a, b = (snapshots.Run(f"nightly-2026070{d}", f"nightly-2026070{d}", {}) for d in (1, 2))
    seen = []

    def edit(runs):
        if not seen:  # another writer is faster once
            seen.append(1)
            snapshots.publish(spark, root, b)
        return [*runs, a]

    snapshots.change(spark, root, edit)
    assert [r.id for r in snapshots.current(spark, root).runs] == [a.id, b.id] and snapshots.current(spark, root).version == 2


def test_a_read_of_few_series_opens_few_files(spark, frame):
    root, skus = scratch_path(spark, "runs"), [f"S{i:03d}" for i in range(300)]
    for run in ("nightly-20260701", "nightly-20260702"):
        parts = serving_tables.run_tables(*tables(spark, run, users=("u1", "u2"), skus=skus))
        snapshots.publish(spark, root, snapshots.write_run(spark, root, run, run, parts))
    run = snapshots.current(spark, root).newest()
    stored = serving_tables.stored(spark, root, "forecasts", (run,))
    read = scans(serving_tables.read_series(stored, [("u1", "S007")]))
    assert read[0]["numFiles"] == 1
    ten = [("u1", s) for s in skus[:10]]
    assert scans(serving_tables.read_series(stored, ten))[0]["numFiles"] <= 10 < len(names_in(spark, f"{root}/{run.tables['forecasts']}"))
    health = frame([("weather", "live")], "signal string, status string")
    as_of = F.lit("2026-07-02").cast("date")
    got = serving_tables.serve(spark, root, "u1", ["S003", "S001", "none"], 14, health, as_of)
    asked = spark.createDataFrame([("u1", i, s, 14) for i, s in enumerate(["S003", "S001", "none"])], "user_id string, position int, sku string, horizon int")
    everything = [serving_tables.stored(spark, root, n).drop("bucket") for n in ("forecasts", "forecast_factors")]
    want = serving.assemble_series(asked, *everything, health, as_of)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    by = {r.sku: r for r in got.collect()}
    assert len(by["S001"].points) == 14 and [f.factor for f in by["S001"].factors] == ["f6", "f5", "f4", "f3", "f2"] and by["none"].points == []
    assert serving_tables.serve(spark, root, "u3", ["S001"], 14, health, as_of).count() == 0


SIGNALS = "source string, observed_date date, ingested_at timestamp, payload string"


def signal_rows(frame, days):
    return frame([(s, f"2026-07-{d:02d}", f"2026-07-{d:02d} {h:02d}:00:00", f"{s}{d}{h}") for s in ("weather", "a b") for d in days for h in (1, 13)], SIGNALS)


def test_pruning_by_zones_reads_the_edge_only(spark, frame):
    path, folders = scratch_path(spark, "signals"), ["source", "observed_date"]
    zones.append_with_zones(signal_rows(frame, range(1, 6)), path, folders, "ingested_at")
    zones.append_with_zones(signal_rows(frame, (5, 6)), path, folders, "ingested_at")
    late = frame([(None, "2026-07-02", None, "undated"), (None, "2026-07-02", "2026-07-02 01:00:00", "dated")], SIGNALS)
    zones.append_with_zones(late, path, folders, "ingested_at")
    before = F.lit("2026-07-03 06:00:00").cast("timestamp")
    found = zones.old_folders(spark, path, folders, before)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and all("/_zones/" in f for f in found.inputFiles())  # the ledger alone
    assert table(found, "source", "observed_date", "whole") == [
        ("a b", "2026-07-01", True), ("a b", "2026-07-02", True), ("a b", "2026-07-03", False), ("weather", "2026-07-01", True),
        ("weather", "2026-07-02", True), ("weather", "2026-07-03", False), (None, "2026-07-02", False)]
    assert zones.prune_zones(spark, path, SIGNALS, folders, "ingested_at", before) == (4, 3)
    left = spark.read.schema(SIGNALS).parquet(path)
    assert left.filter("ingested_at < timestamp '2026-07-03 06:00:00'").count() == 0
    assert left.count() == 2 * (1 + 2 + 4 + 2) + 1 and left.filter("payload = 'undated'").count() == 1
    assert zones.prune_zones(spark, path, SIGNALS, folders, "ingested_at", before) == (0, 0)
    zones.append_with_zones(signal_rows(frame, (1,)), path, folders, "ingested_at")  # a folder that was removed comes back
    assert zones.prune_zones(spark, path, SIGNALS, folders, "ingested_at", before) == (2, 0)
    assert zones.prune_zones(spark, scratch_path(spark, "none"), SIGNALS, folders, "ingested_at", before) == (0, 0)


def test_zones_name_what_a_table_holds(spark, frame):
    path = scratch_path(spark, "signals")
    zones.append_with_zones(signal_rows(frame, (1, 2)), path, ["source", "observed_date"], "ingested_at")
    want = spark.read.schema(SIGNALS).parquet(path).groupBy("source", F.col("observed_date").cast("string").alias("observed_date")).agg(
        F.min("ingested_at").alias("lo"), F.max("ingested_at").alias("hi"))
    assert table(zones.zones(spark, path, ["source", "observed_date"]), "source", "observed_date", "lo", "hi") == table(want)
    assert exists(spark, f"{path}/_zones")
