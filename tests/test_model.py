import pytest
from pyspark.sql import functions as F

from rows import table
from series import daily_sales
from salesflow.operators import features, silver
from salesflow.plans import model, nightly, selection, serving_tables
from salesflow.schemas import FEATURES, FORECAST_FACTORS, SALES_RAW, SERIES
from salesflow.session import materialize
from salesflow.sources import snapshots
from salesflow.sources.layers import append_bronze

DAY = "2026-07-26"
SMALL = model.BoostedTrees(trees=8, depth=4)


def products(frame, n=4):
    return frame([(f"u{i % 2}", f"P{i}", f"Mug {i}", 20.0 + 10 * i) for i in range(n)],
                 "user_id string, sku string, product_name string, base double")


@pytest.fixture(scope="module")
def ranked(spark):
    goods = spark.createDataFrame([(f"u{i % 2}", f"P{i}", "Mug", 20.0 + 10 * i) for i in range(4)],
                                  "user_id string, sku string, product_name string, base double")
    daily = silver.flag_gaps(silver.enforce_types(daily_sales(goods, F.lit(DAY).cast("date"), 400)))
    gold = features.gold_features(daily)
    extra = [c for c in gold.columns if c not in (*SERIES, "date", "quantity")]
    return materialize(selection.split_holdout(gold, extra=extra).drop("holdout"), "ranked")


def test_bands_are_ordered_and_errors_bounded(ranked):
    fitted = model.fit_quantiles(ranked.filter("back > 60"), SMALL)
    held = fitted.predict(ranked.filter("back <= 60"))
    assert held.filter("yhat_lower > yhat or yhat > yhat_upper or yhat_lower < 0").count() == 0
    error = held.agg(selection.mape_of(F.col("quantity"), F.col("yhat")).alias("m")).first()["m"]
    naive = selection.backtest_baseline(ranked).agg(F.avg("mape_baseline").alias("m")).first()["m"]
    assert error < 30 and error < naive + 15
    inside = held.agg(F.avg(F.col("quantity").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("int")).alias("i")).first()["i"]
    assert 0.7 < inside < 0.9
    assert held.select(*SERIES, F.round((F.col("yhat_upper") - F.col("yhat_lower")) / F.col("level"), 6)).distinct().count() > 40
    weights = fitted.fitted.importances()
    assert list(weights) == FEATURES and sum(weights.values()) == pytest.approx(1.0)


def test_short_series_get_no_model(ranked):
    fitted = model.scales(ranked.filter("back <= 50"))
    assert model.trainable(ranked.filter("back <= 50"), fitted).count() == 0


class WeekEcho:
    """A stand-in model that predicts the value of seven rows ago."""

    def fit(self, rows):
        return self

    def transform(self, rows):
        return rows.withColumn("prediction", F.coalesce(F.col("lag_7") / F.col("level"), F.lit(0.0)))

    def importances(self):
        return {f: 1.0 for f in FEATURES}


def test_recursion_feeds_predictions_back(frame):
    daily = frame([("u1", "A", f"2026-07-{d:02d}", float(d)) for d in range(1, 8)],
                  "user_id string, sku string, date date, quantity double")
    bands = frame([("u1", "A", 2.0, -0.5, 0.5)], "user_id string, sku string, scale double, q_low double, q_high double")
    context = frame([], "user_id string, date date, is_holiday boolean, days_to_holiday int, is_school_break boolean, "
                        "temp_avg double, precip_mm double, event_count bigint, large_event_count bigint, trends_interest double")
    got = model.recursive_forecast(model.QuantileModel(WeekEcho(), bands), daily, context, F.lit("2026-07-08").cast("date"), 14)
    rows = got.orderBy("date").collect()
    assert [r["yhat"] for r in rows] == pytest.approx([float(d) for d in range(1, 8)] * 2)
    assert str(rows[0]["date"]) == "2026-07-08" and rows[0]["yhat_lower"] == 0.0 and rows[0]["yhat_upper"] == 3.0


def empty_context(spark):
    return spark.createDataFrame([], "user_id string, date date, is_holiday boolean, days_to_holiday int, is_school_break boolean, "
                                     "temp_avg double, precip_mm double, event_count bigint, large_event_count bigint, "
                                     "trends_interest double")


def test_one_pass_equals_the_stepwise_form(spark, ranked):
    fitted = model.fit_quantiles(ranked, SMALL)
    daily, start = ranked.select(*SERIES, "date", "quantity"), F.date_add(F.lit(DAY).cast("date"), 1)
    one = model.recursive_forecast(fitted, daily, empty_context(spark), start, 6)
    steps = model.forecast_stepwise(fitted, model.series_state(fitted, daily, empty_context(spark), start, 6), 6)
    a, b = (df.orderBy(*SERIES, "date").collect() for df in (one, steps))
    assert len(a) == len(b) == 24
    for x, y in zip(a, b):
        assert x["date"] == y["date"]
        assert [x[c] for c in ("yhat", "yhat_lower", "yhat_upper")] == pytest.approx([y[c] for c in ("yhat", "yhat_lower", "yhat_upper")])


def test_own_model_per_series(frame):
    daily = frame([("u1", "A", f"2026-07-{d:02d}", float(d)) for d in range(1, 8)],
                  "user_id string, sku string, date date, quantity double")

    def mean(rows):
        return rows.groupby(["user_id", "sku"], as_index=False)["quantity"].mean()

    assert table(model.forecast_each(daily, mean, "user_id string, sku string, quantity double")) == [("u1", "A", 4.0)]


def test_model_is_saved_and_loaded(ranked, spark):
    from salesflow.session import scratch_path

    fitted = model.fit_quantiles(ranked, model.BoostedTrees(trees=2, depth=2))
    path = scratch_path(spark, "model")
    fitted.fitted.save(path)
    assert model.FittedTrees.load(path).importances() == fitted.fitted.importances()


def test_whole_nightly_run(spark, frame):
    sales = daily_sales(products(frame), F.lit(DAY).cast("date"), 150).withColumn("ingested_at", F.lit(DAY).cast("timestamp")) \
        .withColumn("seq", F.monotonically_increasing_id())
    days = sales.select("user_id", "date").distinct()
    stamped = days.withColumns({"ingested_at": F.lit(DAY).cast("timestamp"), "seq": F.lit(1)})
    inputs = nightly.Inputs(
        sales=sales, profiles=frame([("u0", "US"), ("u1", "US")], "id string, country_code string"),
        holidays=frame([("US", "2026-07-04"), ("US", "2026-08-01")], "country_code string, date date"),
        breaks=frame([("u0", "2026-06-15", "2026-07-31")], "user_id string, start_date date, end_date date"),
        weather=stamped.withColumns({"temp_avg": F.lit(20.0), "precip_mm": F.lit(1.0)}),
        trends=stamped.withColumn("interest", F.lit(55.0)),
        events=stamped.withColumns({"event_id": F.date_format("date", "yyyyMMdd"), "large_venue": F.lit(True), "category": F.lit("Music")}),
        sales_order=["ingested_at", "seq"], signal_order=["ingested_at", "seq"])
    outputs = nightly.run(inputs, F.lit(DAY).cast("date"), estimator=model.BoostedTrees(trees=5, depth=3))
    summary = outputs.summary.first()
    assert (summary["batch"], summary["status"], summary["skus"], summary["forecasts"]) == ("nightly-20260726", "ok", 4, 120)
    assert outputs.forecasts.filter("yhat_lower > yhat or yhat > yhat_upper").count() == 0
    metrics = outputs.metrics.collect()
    assert len(metrics) == 4 and all(m["mape_backtest"] <= 60 for m in metrics)
    chosen = [m for m in metrics if m["chosen"] == "boosted"]
    assert chosen and all(m["factors"] for m in chosen)
    assert summary["factors"] == sum(len(m["factors"]) for m in chosen)
    root = str(spark.conf.get("spark.checkpoint.dir")) + "/serving"
    for _ in range(2):
        nightly.publish(spark, outputs, root)
    assert serving_tables.stored(spark, root, "forecasts").count() == 120
    assert serving_tables.stored(spark, root, "gold_model_metrics").count() == 4


def test_run_over_stored_tables(spark, frame, tmp_path):
    root, as_of = str(tmp_path / "tables"), F.lit(DAY).cast("date")
    assert nightly.run_stored(spark, root, as_of).first().asDict() == {
        "batch": "nightly-20260726", "status": "empty", "skus": 0, "forecasts": 0, "factors": 0}
    sales = daily_sales(products(frame), as_of, 120).withColumn("ingested_at", as_of.cast("timestamp")).withColumn("seq", F.xxhash64("sku", "date"))
    sales.select(*[c.split()[0] for c in SALES_RAW.split(", ")]).write.parquet(f"{root}/sales_daily")
    frame([("u0", "US"), ("u1", "US")], "id string, country_code string").write.parquet(f"{root}/profiles")
    signals = frame([("weather", "u0", "2026-07-20", "2026-07-20", '{"user_id":"u0","temp_avg":21.5}', 1),
                     ("weather", "u0", "2025-01-01", "2025-01-01", '{"user_id":"u0","temp_avg":1.0}', 2),
                     ("holidays", "US", "2026-07-04", "2026-07-01", '{"country_code":"US"}', 3)],
                    "source string, entity_key string, observed_at date, ingested_at timestamp, payload string, seq bigint")
    append_bronze(signals.withColumn("schema_version", F.lit(1)), f"{root}/signal_events")
    inputs = nightly.stored_inputs(spark, root, as_of)
    assert table(inputs.weather, "date", "temp_avg") == [("2026-07-20", 21.5)] and inputs.holidays.count() == 1
    for run in ("nightly-20260701", "nightly-20260725"):  # one beyond a week, one within
        day = f"{run[8:12]}-{run[12:14]}-{run[14:]}"
        old = frame([("u0", "P0", "2026-07-29", run, "boosted:1", None, None, None, None, day)],
                    "user_id string, sku string, forecast_date date, model_run_id string, model_version string, yhat double, yhat_lower double, "
                    "yhat_upper double, mape_backtest double, generated_at timestamp")
        old = old.withColumns({c: F.col(c).cast("decimal(14, 2)") for c in ("yhat", "yhat_lower", "yhat_upper")}).withColumn(
            "mape_backtest", F.col("mape_backtest").cast("decimal(6, 2)"))
        factors = spark.createDataFrame([], FORECAST_FACTORS)
        snapshots.publish(spark, root, snapshots.write_run(spark, root, run, run, serving_tables.run_tables(old, factors)))
    summary = nightly.run_stored(spark, root, as_of, 7, model.BoostedTrees(trees=2, depth=2)).first()
    assert (summary["status"], summary["skus"], summary["forecasts"]) == ("ok", 4, 28)
    held = serving_tables.stored(spark, root, "forecasts")
    assert table(held.select("model_run_id").distinct()) == [("nightly-20260725",), ("nightly-20260726",)] and held.count() == 29
    assert table(spark.read.parquet(f"{root}/signal_events"), "seq") == [(1,), (3,)]
    paths = serving_tables.stored(spark, root, "gold_model_metrics").filter("chosen = 'boosted'").select("artifact_path").distinct().collect()
    assert all(model.QuantileModel.load(spark, r[0]).errors.grid for r in paths)
