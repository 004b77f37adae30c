import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from rows import table
from salesflow.operators import features, keyed, silver
from salesflow.operators.keyed import latest

SALES = ("user_id string, sku string, date date, quantity double, revenue double, price double, promo_flag boolean, "
         "ingested_at timestamp, seq bigint")


def sale(day, qty, ingested="2026-07-02", seq=0, sku="A", user="u1", promo=None):
    return (user, sku, day, qty if qty is None else float(qty), 10.0, None, promo, ingested, seq)


def test_latest_ingested_record_wins(frame):
    raw = frame([sale("2026-07-01", 5, "2026-07-02"), sale("2026-07-01", 9, "2026-07-03")], SALES)
    assert table(silver.dedupe_latest(raw), "quantity") == [(9.0,)]


def test_equal_times_are_decided_by_sequence_and_missing_times_lose(frame):
    raw = frame([sale("2026-07-01", 1, "2026-07-02", 1), sale("2026-07-01", 2, "2026-07-02", 2),
                 sale("2026-07-01", 3, None, 3)], SALES)
    assert table(silver.dedupe_latest(raw), "quantity") == [(2.0,)]


def test_dedupe_matches_a_plain_loop_on_random_input(frame):
    rng = random.Random(3)
    rows = [sale(f"2026-07-{rng.randint(1, 5):02d}", i, f"2026-08-{rng.randint(1, 9):02d}", i, rng.choice("AB"))
            for i in range(300)]
    best = {}
    for r in rows:
        key = (r[1], r[2])
        if key not in best or (r[7], r[8]) >= (best[key][7], best[key][8]):
            best[key] = r
    got = table(silver.dedupe_latest(frame(rows, SALES)), "sku", "date", "quantity")
    assert got == sorted((k[0], k[1], r[3]) for k, r in best.items())


def test_gap_flag_marks_the_row_behind_the_hole(frame):
    raw = frame([sale(d, 1) for d in ("2026-07-01", "2026-07-02", "2026-07-05")], SALES)
    assert table(silver.to_silver(raw), "date", "gap_flag") == [
        ("2026-07-01", False), ("2026-07-02", False), ("2026-07-05", True)]


def test_quantity_is_clamped_and_promo_defaults(frame):
    raw = frame([sale("2026-07-01", -3)], SALES)
    assert table(silver.to_silver(raw), "quantity", "price", "promo_flag") == [(0.0, None, False)]
    assert table(silver.to_silver(frame([sale("2026-07-01", None)], SALES)), "quantity") == [(None,)]


def test_latest_handles_a_key_that_holds_most_rows(frame, spark):
    rows = spark.range(20000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id) end as k", "id as t")
    assert table(latest(rows, ["k"], ["t"]).filter("k = 'hot'")) == [("hot", 19998)]


def test_events_per_day(frame):
    raw = frame([("u1", "2026-08-01", True, "Music", 1), ("u1", "2026-08-01", False, "Sports", 2),
                 ("u1", "2026-08-02", False, "Music", 3), ("u1", "2026-08-02", None, "", 4)],
                "user_id string, date date, large_venue boolean, category string, seq bigint")
    assert table(silver.events_to_daily(raw)) == [
        ("u1", "2026-08-01", 2, 1, ["Music", "Sports"]), ("u1", "2026-08-02", 2, 0, ["Music"])]


def test_republished_events_count_once(frame):
    raw = frame([("u1", "2026-08-01", True, "Music", "e1", i) for i in range(4)],
                "user_id string, date date, large_venue boolean, category string, event_id string, seq bigint")
    assert table(silver.events_to_daily(raw, ["user_id", "event_id"], ["seq"]), "event_count") == [(1,)]


def test_forward_fill(frame):
    points = frame([("CPIAUCSL", "2026-06-01", 322.5)], "series string, date date, value double")
    days = frame([("2026-05-30",), ("2026-06-15",), ("2026-07-02",)], "date date")
    assert table(silver.forward_fill(points, days, ["series"])) == [
        ("CPIAUCSL", "2026-05-30", None), ("CPIAUCSL", "2026-06-15", 322.5), ("CPIAUCSL", "2026-07-02", 322.5)]


def test_forward_fill_matches_a_plain_loop(frame):
    rng = random.Random(5)
    first = date(2026, 1, 1)
    points = [(s, str(first + timedelta(days=d)), float(d)) for s in "ab" for d in rng.sample(range(60), 8)]
    asked = [str(first + timedelta(days=d)) for d in rng.sample(range(90), 20)]
    want = sorted((s, d, max([(p[1], p[2]) for p in points if p[0] == s and p[1] <= d], default=(0, None))[1])
                  for s in "ab" for d in asked)
    got = table(silver.forward_fill(frame(points, "series string, date date, value double"),
                                    frame([(d,) for d in asked], "date date"), ["series"]))
    assert sorted(got, key=str) == sorted(want, key=str)


def series(frame, days=35):
    first = date(2026, 6, 1)
    return frame([("u1", "A", str(first + timedelta(days=i)), float(i % 7 + 1), i == 20, False) for i in range(days)],
                 "user_id string, sku string, date date, quantity double, promo_flag boolean, gap_flag boolean")


def test_lags_and_means_are_positional(frame):
    rows = {str(r["date"]): r for r in features.gold_features(series(frame)).collect()}
    q = [float(i % 7 + 1) for i in range(35)]
    last = rows["2026-06-29"]
    assert (last["lag_1"], last["lag_7"], last["lag_28"]) == (q[27], q[21], q[0])
    assert last["roll_mean_7"] == sum(q[21:28]) / 7
    first = rows["2026-06-01"]
    assert first["lag_1"] is None and first["roll_mean_7"] is None and first["roll_mean_28"] is None
    assert rows["2026-06-02"]["roll_mean_28"] == 1.0
    saturday = rows["2026-07-04"]
    assert (saturday["dow"], saturday["is_weekend"], saturday["month"]) == (5, True, 7)


def test_lags_skip_holes(frame):
    rows = frame([("u1", "A", d, q, False, False) for d, q in (("2026-06-01", 1.0), ("2026-06-09", 2.0))],
                 "user_id string, sku string, date date, quantity double, promo_flag boolean, gap_flag boolean")
    assert table(features.add_lags(rows, [1]), "date", "lag_1") == [("2026-06-01", None), ("2026-06-09", 1.0)]


def test_signals_join_with_defaults(frame):
    day = "2026-07-02"
    gold = features.gold_features(
        series(frame), weather=frame([("u1", day, 25.5, 1.2)], "user_id string, date date, temp_avg double, precip_mm double"),
        calendar=frame([("u1", day, True, 0, False)],
                       "user_id string, date date, is_holiday boolean, days_to_holiday int, is_school_break boolean"),
        trends=frame([("u1", day, 61.0)], "user_id string, date date, interest double"),
        events=frame([("u1", day, 3, 1)], "user_id string, date date, event_count bigint, large_event_count bigint"))
    rows = {str(r["date"]): r for r in gold.collect()}
    hit, miss = rows[day], rows["2026-07-01"]
    assert (hit["temp_avg"], hit["precip_mm"], hit["is_holiday"], hit["days_to_holiday"]) == (25.5, 1.2, True, 0)
    assert (hit["trends_interest"], hit["event_count"], hit["large_event_count"]) == (61.0, 3, 1)
    assert miss["temp_avg"] is None and miss["is_holiday"] is False and miss["event_count"] == 0


def test_gold_schema(frame):
    from salesflow.schemas import GOLD_FEATURES

    spark = series(frame).sparkSession
    want = spark.createDataFrame([], GOLD_FEATURES).schema
    got = features.gold_features(series(frame)).schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in want]


def test_top_n_beyond_the_group_limit(spark):
    rows = spark.range(9000).selectExpr("case when id % 9 = 0 then 'b' else 'a' end as k", "id * 7919 % 9001 as v")
    got = keyed.top_n(rows, ["k"], [F.col("v")], 1500, "at")
    plain = sorted(r.v for r in rows.filter("k = 'a'").collect())[:1500]
    assert sorted(r.v for r in got.filter("k = 'a'").collect()) == plain and got.filter("k = 'b'").count() == 1000
    assert got.columns == ["k", "v", "at"]


def test_pages_cover_every_row(spark):
    rows = spark.range(2500).selectExpr("id * 7919 % 9001 as v")
    got = keyed.pages(rows, ["v"], 100).collect()
    order = sorted(r.v for r in got)
    assert len(order) == 2500 and all(order.index(r.v) // 100 == r.page for r in got[:200])
