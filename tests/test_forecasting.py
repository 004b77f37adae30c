import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rows import table
from salesflow.plans import baseline, factors, forecast, selection
from salesflow.schemas import FEATURES, MOMENTUM_FEATURES

DAILY = "user_id string, sku string, date date, quantity double"


def history(frame, values, sku="A"):
    first = date(2026, 1, 1)
    return frame([("u1", sku, str(first + timedelta(days=i)), float(v)) for i, v in enumerate(values)], DAILY)


def day(text):
    return F.lit(text).cast("date")


def naive(frame, values, horizon):
    rows = baseline.seasonal_naive(history(frame, values), day("2026-07-27"), horizon).orderBy("date").collect()
    return [(r["yhat"], r["yhat_lower"], r["yhat_upper"]) for r in rows]


def loop(values, horizon):
    """The same rule as a recurrence, to compare with."""
    tail = values[-28:]
    mean = sum(tail) / len(tail) if tail else 0.0
    diffs = [b - a for a, b in zip(values, values[7:])]
    sigma = math.sqrt(sum(d * d for d in diffs) / len(diffs)) if diffs else max(mean * 0.2, 1.0)
    known, out = list(values), []
    for step in range(1, horizon + 1):
        value = known[len(known) - 7] if len(known) >= 7 else mean
        known.append(max(value, 0.0))
        out.append((max(value, 0.0), max(value - 1.2816 * sigma * step ** 0.5, 0.0), value + 1.2816 * sigma * step ** 0.5))
    return out


def test_week_repeats(frame):
    points = naive(frame, [10, 20, 30, 40, 50, 60, 70] * 4, 7)
    assert [p[0] for p in points] == [10, 20, 30, 40, 50, 60, 70]


def test_band_is_ordered_and_widens(frame):
    points = naive(frame, [i % 7 + 1 + (i % 3) * 0.5 for i in range(56)], 14)
    assert all(low <= mid <= high for mid, low, high in points)
    assert points[-1][2] - points[-1][0] > points[0][2] - points[0][0]


def test_short_history_uses_the_mean(frame):
    assert [p[0] for p in naive(frame, [5, 7], 3)] == [6.0, 6.0, 6.0]


@pytest.mark.parametrize("n", [1, 3, 6, 7, 8, 13, 30, 59])
def test_closed_form_equals_the_recurrence(frame, n):
    rng = random.Random(n)
    values = [float(rng.randint(0, 40)) for _ in range(n)]
    for got, want in zip(naive(frame, values, 30), loop(values, 30)):
        assert got == pytest.approx(want)


def test_errors(frame):
    rows = frame([("m", 10.0, 11.0), ("m", 0.0, 5.0), ("m", 20.0, 18.0), ("z", 0.0, 1.0), ("z", 0.0, 2.0)],
                 "k string, a double, p double")
    assert dict(table(selection.mape(rows, ["k"], "a", "p"))) == {"m": pytest.approx(10.0), "z": None}
    same = frame([("e", 1.0, 1.0), ("e", 2.0, 2.0)], "k string, a double, p double")
    assert table(selection.rmse(same, ["k"], "a", "p")) == [("e", 0.0)]
    assert selection.rmse(same.limit(0), ["k"], "a", "p").count() == 0
    assert same.limit(0).agg(selection.rmse_of(F.col("a"), F.col("p")).alias("r")).first()["r"] is None


@pytest.mark.parametrize("base, boosted, nulls, want", [
    (20.0, 12.0, 0.1, "boosted"), (12.0, 12.0, 0.1, "seasonal-naive"), (10.0, 15.0, 0.1, "seasonal-naive"),
    (25.0, 8.0, 0.7, "seasonal-naive"), (15.0, None, 0.1, "seasonal-naive"), (None, 12.0, 0.1, "boosted")])
def test_choice(frame, base, boosted, nulls, want):
    rows = frame([(base, boosted, nulls)], "b double, m double, n double")
    got = rows.select(selection.choose_model(F.col("b"), F.col("m"), F.col("n")).alias("c"))
    assert got.first()["c"] == want


def test_null_share(frame):
    rows = frame([("k", 20.0, None, 3, 0), ("k", None, None, None, 1)],
                 "k string, temp_avg double, trends_interest double, days_to_holiday int, event_count bigint")
    assert table(selection.null_fraction(rows, ["k"])) == [("k", 0.5)]
    assert rows.limit(0).agg(selection.null_share().alias("s")).first()["s"] == 1.0


def gold_like(frame, values):
    rows = history(frame, values)
    return rows.withColumns({c: F.lit(None).cast("double") for c in ("temp_avg", "trends_interest", "days_to_holiday")}) \
        .withColumn("event_count", F.lit(0).cast("bigint"))


def test_backtest_without_enough_rows_for_a_model(frame):
    got = selection.backtest(gold_like(frame, [i % 7 + 1 for i in range(80)])).first()
    assert got["mape_boosted"] is None and got["chosen"] == "seasonal-naive" and got["train_rows"] == 20
    assert got["external_null_frac"] == 0.75


def test_backtest_equals_a_plain_loop(frame):
    rng = random.Random(9)
    values = [float(rng.randint(0, 30)) for _ in range(130)]
    predicted = [p[0] for p in loop(values[:-60], 60)]
    want = 100 * sum(abs(a - p) / a for a, p in zip(values[-60:], predicted) if a) / sum(1 for a in values[-60:] if a)
    assert selection.backtest_baseline(gold_like(frame, values)).first()["mape_baseline"] == pytest.approx(want)


def test_backtest_of_a_short_series_scores_hundred(frame):
    assert selection.backtest_baseline(gold_like(frame, [5.0] * 40)).first()["mape_baseline"] == 100.0


def test_split_keeps_the_newest_rows(frame):
    rows = selection.split_holdout(history(frame, range(70)))
    assert rows.filter("holdout").count() == 60
    assert rows.filter("not holdout").agg(F.max("quantity")).first()[0] == 9.0


def context(frame):
    return forecast.future_context(
        frame([("u1", "2026-07-27", True, 0, False), ("u1", "2026-06-01", True, 0, False)],
              "user_id string, date date, is_holiday boolean, days_to_holiday int, is_school_break boolean"),
        frame([("u1", "2026-07-28", 21.0, 0.5)], "user_id string, date date, temp_avg double, precip_mm double"),
        frame([("u1", "2026-08-09", 2, 1)], "user_id string, date date, event_count bigint, large_event_count bigint"),
        frame([("u1", "2026-07-20", 66.0), ("u1", "2026-07-10", 5.0)], "user_id string, date date, interest double"),
        day("2026-07-27"), 7)


def test_future_context(frame):
    assert table(context(frame), "date", "is_holiday", "temp_avg", "trends_interest") == [
        ("2026-07-27", True, None, 66.0), ("2026-07-28", None, 21.0, 66.0)]


def test_carried_interest_may_be_missing(frame):
    ctx = frame([("u1", "2026-07-27")], "user_id string, date date")
    trends = frame([("u1", "2026-07-01", 5.0), ("u1", "2026-07-02", None)], "user_id string, date date, interest double")
    assert table(forecast.carry_last(ctx, trends), "trends_interest") == [(None,)]


def test_inference_row(frame):
    values = [float(i) for i in range(1, 11)]
    days = forecast.history_arrays(history(frame, values)).withColumn("date", day("2026-07-27"))
    row = forecast.inference_rows(days, context(frame)).first()
    assert (row["lag_1"], row["lag_7"], row["lag_14"]) == (10.0, 4.0, None)
    assert row["roll_mean_7"] == 7.0 and row["roll_mean_28"] == 5.5
    assert (row["dow"], row["is_holiday"], row["promo_flag"], row["event_count"]) == (0, True, False, 0)
    assert set(FEATURES) <= set(row.asDict())


def test_missing_model_falls_back(frame):
    stats = baseline.history_stats(history(frame, [10.0] * 14))
    models = frame([("u1", "A", "boosted")], "user_id string, sku string, chosen string")
    none = frame([], "user_id string, sku string, date date, yhat double, yhat_lower double, yhat_upper double")
    got = forecast.dispatch(models, stats, day("2026-07-27"), 7, none)
    assert [r["yhat"] for r in got.collect()] == [10.0] * 7


def test_published_rows_share_one_batch(frame):
    rows = history(frame, [float(i % 7) for i in range(60)])
    models = frame([("u1", "A", "seasonal-naive", "seasonal-naive", 12.345)],
                   "user_id string, sku string, chosen string, model_version string, mape_backtest double")
    pts = forecast.dispatch(models, baseline.history_stats(rows), day("2026-07-27"), 7)
    out = forecast.forecast_rows(pts, models, F.lit("nightly-20260727"), F.lit("2026-07-26").cast("timestamp"))
    assert out.count() == 7 and table(out.select("model_run_id").distinct()) == [("nightly-20260727",)]


def test_newest_training_result(frame):
    runs = frame([("u1", "A", "r1", "2026-07-01"), ("u1", "A", "r2", "2026-07-02"), ("u1", "A", "r3", "2026-07-02")],
                 "user_id string, sku string, model_run_id string, trained_at timestamp")
    assert table(forecast.latest_models(runs), "model_run_id") == [("r3",)]


def test_directions(frame):
    rows = frame([("u1", "A", float(i), float(i), float(-i), 3.0, None) for i in range(12)],
                 "user_id string, sku string, quantity double, up double, down double, flat double, none double")
    got = dict(table(factors.directions(rows, ["user_id", "sku"], ["up", "down", "flat", "none"]), "factor", "direction"))
    assert got == {"up": "up", "down": "down", "flat": "neutral", "none": "neutral"}


def test_few_pairs_are_neutral(frame):
    rows = frame([("u1", "A", float(i), float(i)) for i in range(9)], "user_id string, sku string, quantity double, x double")
    assert table(factors.directions(rows, ["user_id", "sku"], ["x"]), "direction") == [("neutral",)]


def test_top_factors_drop_momentum_and_sum_to_one(frame):
    weights = {"lag_7": 0.5, "roll_mean_7": 0.3, "temp_avg": 0.2, "dow": 0.1, "month": 0.1, "event_count": 0.05,
               "precip_mm": 0.04, "promo_flag": 0.03, "is_holiday": 0.0}
    imp = frame([("u1", "A", f, w) for f, w in weights.items()], "user_id string, sku string, factor string, importance double")
    rows = frame([("u1", "A", float(i), float(i)) for i in range(20)], "user_id string, sku string, quantity double, temp_avg double")
    for f in FEATURES:
        if f not in rows.columns:
            rows = rows.withColumn(f, F.lit(0.0))
    got = factors.top_factors(imp, rows).orderBy("rank").collect()
    assert [r["factor"] for r in got] == ["temp_avg", "dow", "month", "event_count", "precip_mm"]
    assert not set(MOMENTUM_FEATURES) & {r["factor"] for r in got}
    assert sum(r["importance"] for r in got) == pytest.approx(1.0, abs=1e-3) and got[0]["direction"] == "up"
