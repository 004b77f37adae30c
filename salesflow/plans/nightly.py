"""The whole nightly run: signals and sales in, forecasts, factors and metrics out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesflow.functions.scalars import batch_id
from salesflow.operators import calendar, features, silver
from salesflow.operators.zones import prune_zones
from salesflow.plans import baseline, factors, forecast, model, selection, serving_tables
from salesflow.schemas import BRONZE, CALENDAR_EVENTS, FORECASTS, PROFILES, SALES_RAW, SERIES
from salesflow.session import materialize
from salesflow.sources import snapshots
from salesflow.sources.envelopes import split_signals
from salesflow.sources.layers import lookback, read_layer

HORIZON = 30
RUN_RETENTION_DAYS = 7
SIGNAL_LOOKBACK_DAYS = 400


@dataclass
class Inputs:
    """Typed inputs: raw sales with their ingest order, daily signals, tenants and calendars."""

    sales: DataFrame
    profiles: DataFrame
    holidays: DataFrame
    breaks: DataFrame
    weather: DataFrame
    trends: DataFrame
    events: DataFrame
    sales_order: list[str]
    signal_order: list[str]


@dataclass
class Outputs:
    gold: DataFrame
    metrics: DataFrame
    forecasts: DataFrame
    factors: DataFrame
    summary: DataFrame
    model: model.QuantileModel | None = None


def train(gold: DataFrame, run_id: Column, trained_at: Column, estimator: model.Estimator | None = None,
          ) -> tuple[DataFrame, model.QuantileModel]:
    """Backtest both candidates, choose per series, fit the final model and attribute its factors."""
    ranked = materialize(selection.split_holdout(
        gold, extra=[c for c in gold.columns if c not in (*SERIES, "date", "quantity")]).drop("holdout"), "ranked")
    scored = selection.backtest(ranked, model.boosted_scores(ranked, estimator))
    final = model.fit_quantiles(ranked, estimator)
    chosen = materialize(scored, "scored")
    boosted = F.col("chosen") == selection.BOOSTED
    series = chosen.filter(boosted).select(*SERIES)
    shown = factors.top_factors(
        model.series_importances(ranked.join(series, SERIES, "left_semi"), final), ranked.join(series, SERIES, "left_semi"))
    listed = shown.groupBy(*SERIES).agg(F.array_sort(F.collect_list(
        F.struct("rank", "factor", "importance", "direction"))).alias("_f")).select(
        *SERIES, F.transform("_f", lambda x: F.struct(
            x["factor"].alias("factor"), x["importance"].alias("importance"), x["direction"].alias("direction"),
        )).alias("factors"))
    metrics = chosen.join(listed, SERIES, "left").select(
        run_id.alias("model_run_id"), *SERIES,
        F.when(boosted, F.concat(F.lit(f"{selection.BOOSTED}:"), run_id)).otherwise(selection.BASELINE).alias("model_version"),
        F.when(boosted, F.col("mape_boosted")).otherwise(F.col("mape_baseline")).alias("mape_backtest"),
        "mape_baseline", "chosen", F.round("external_null_frac", 4).alias("external_null_frac"),
        trained_at.alias("trained_at"), "factors")
    return metrics, final


def build_gold(inputs: Inputs, as_of: Column, horizon: int = HORIZON) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Gold features, the daily series they were built from, and the daily signals."""
    daily = silver.to_silver(inputs.sales, inputs.sales_order)
    spans = inputs.sales.groupBy("user_id").agg(F.min("date").alias("start_date")).select(
        "user_id", "start_date", F.date_add(as_of, horizon).alias("end_date"))
    signals = {
        "weather": silver.latest_per_day(inputs.weather, ["user_id"], inputs.signal_order),
        "trends": silver.latest_per_day(inputs.trends, ["user_id"], inputs.signal_order),
        "events": silver.events_to_daily(inputs.events, ["user_id", "event_id"], inputs.signal_order),
        "calendar": calendar.calendar_daily(spans, inputs.profiles, inputs.holidays, inputs.breaks),
    }
    gold = features.gold_features(daily, signals["weather"], signals["calendar"], signals["trends"], signals["events"])
    return gold, daily, signals


def run(inputs: Inputs, as_of: Column, horizon: int = HORIZON, estimator: model.Estimator | None = None) -> Outputs:
    """One batch over all tenants. Only the summary is small; nothing else leaves the executors."""
    rows, _, signals = build_gold(inputs, as_of, horizon)
    gold = materialize(rows, "gold")
    run_id, stamp, start = batch_id(as_of), as_of.cast("timestamp"), F.date_add(as_of, 1)
    metrics, final = train(gold, run_id, stamp, estimator)
    metrics = materialize(metrics, "metrics")
    daily = gold.select(*SERIES, "date", "quantity")
    context = forecast.future_context(
        signals["calendar"], signals["weather"], signals["events"], signals["trends"], start, horizon)
    chosen = metrics.filter(F.col("chosen") == selection.BOOSTED).select(*SERIES)
    boosted = model.recursive_forecast(final, daily.join(chosen, SERIES, "left_semi"), context, start, horizon)
    points = forecast.dispatch(metrics, baseline.history_stats(daily), start, horizon, boosted)
    forecasts = materialize(forecast.forecast_rows(points, metrics, run_id, stamp), "forecasts")
    shown = forecast.factor_rows(metrics, run_id)
    return Outputs(gold, metrics, forecasts, shown, run_summary(forecasts, shown, run_id), final)


def publish(spark: SparkSession, outputs: Outputs, root: str) -> None:
    """Write a run to folders of its own and make it visible as a whole; a repeated run takes the place of the earlier one.

    A run that is cut off leaves what was visible before. The metrics of a run are its own table, so those of the runs before stay.
    """
    run_id = outputs.summary.first()["batch"]
    tables = serving_tables.run_tables(outputs.forecasts, outputs.factors)

    def metrics(path: str) -> None:
        kept = F.lit(None).cast("string")
        if outputs.model is not None and hasattr(outputs.model.fitted, "save"):
            folder = f"{path.rsplit('/', 1)[0]}/model"
            outputs.model.save(folder)
            kept = F.when(F.col("chosen") == selection.BOOSTED, folder)
        outputs.metrics.withColumn("artifact_path", kept).write.parquet(path)

    run = snapshots.write_run(spark, root, run_id, run_id, {**tables, "gold_model_metrics": metrics})
    snapshots.publish(spark, root, run)


def run_summary(forecasts: DataFrame, factors: DataFrame | None = None, run_id: Column | None = None) -> DataFrame:
    """One row per batch: status, series, forecast rows and factor rows. ``run_id`` has its row, ``empty``, without any."""
    done = forecasts.groupBy(F.col("model_run_id").alias("batch")).agg(
        F.lit("ok").alias("status"), F.count_distinct("user_id", "sku").alias("skus"),
        F.count(F.lit(1)).alias("forecasts"))
    if run_id is not None:
        batch = forecasts.sparkSession.range(1).select(run_id.alias("batch"))
        done = batch.join(done, "batch", "full").select(
            "batch", F.coalesce("status", F.lit("empty")).alias("status"), *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("skus", "forecasts")])
    if factors is None:
        return done.withColumn("factors", F.lit(0).cast("bigint"))
    shown = factors.groupBy(F.col("model_run_id").alias("batch")).agg(F.count(F.lit(1)).alias("factors"))
    return done.join(shown, "batch", "left").withColumn("factors", F.coalesce("factors", F.lit(0)))


def stored_inputs(spark: SparkSession, root: str, as_of: Column, days: int = SIGNAL_LOOKBACK_DAYS) -> Inputs:
    """Inputs of a run from stored tables: sales_daily, signal_events (Bronze, the last ``days``), profiles, calendar_events."""

    def table(name: str, schema: str) -> DataFrame:
        return read_layer(spark, f"{root}/{name}", schema)

    parts = split_signals(lookback(table("signal_events", BRONZE), as_of, days), ["seq"])
    stamp = ["ingested_at", "seq"]
    return Inputs(
        sales=table("sales_daily", SALES_RAW), profiles=table("profiles", PROFILES), breaks=table("calendar_events", CALENDAR_EVENTS),
        holidays=parts["holidays"].select("country_code", "date").distinct(),
        weather=parts["weather"].select("user_id", "date", "temp_avg", "precip_mm", *stamp),
        trends=parts["trends"].select("user_id", "date", "interest", *stamp),
        events=parts["events"].select("user_id", "date", "event_id", "category", "large_venue", *stamp),
        sales_order=stamp, signal_order=stamp)


def run_stored(spark: SparkSession, root: str, as_of: Column, horizon: int = HORIZON, estimator: model.Estimator | None = None) -> DataFrame:
    """A whole run over the tables under ``root``: forecasts, factors, metrics and model published, old rows pruned.

    Returns the summary, with status ``empty`` where there are no sales or no tenants.
    """
    inputs = stored_inputs(spark, root, as_of)
    if inputs.sales.isEmpty() or inputs.profiles.isEmpty():
        none = spark.createDataFrame([], FORECASTS)
        return run_summary(none, None, batch_id(as_of))
    outputs = run(inputs, as_of, horizon, estimator)
    publish(spark, outputs, root)
    prune(spark, root, as_of)
    return outputs.summary


def prune(spark: SparkSession, root: str, as_of: Column) -> None:
    """Keep a week of runs and the signals within the lookback. Neither opens a data file, but for signals of the days at the limit."""
    first = spark.range(1).select(batch_id(F.date_sub(as_of, RUN_RETENTION_DAYS))).first()[0]
    snapshots.prune(spark, root, first)
    snapshots.vacuum(spark, root)
    old = as_of.cast("timestamp") - F.expr(f"interval {SIGNAL_LOOKBACK_DAYS} days")
    prune_zones(spark, f"{root}/signal_events", f"{BRONZE}, observed_date date", ["source", "observed_date"], "ingested_at", old)
