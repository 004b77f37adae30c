"""Accuracy measures, holdout split, baseline backtest and model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesflow.plans.baseline import history_columns, naive_value, newest_first
from salesflow.functions.scalars import clamp
from salesflow.schemas import EXTERNAL_FEATURES, SERIES

HOLDOUT_ROWS = 60
NULL_LIMIT = 0.5
BASELINE = "seasonal-naive"
BOOSTED = "boosted"


def mape_of(actual: Column, predicted: Column) -> Column:
    """Mean absolute percentage error over non-zero actuals, NULL when there are none."""
    return F.avg(F.when(actual != 0, F.abs(actual - predicted) / F.abs(F.nullif(actual, F.lit(0.0))))) * 100


def rmse_of(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def mape(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    return df.groupBy(*keys).agg(mape_of(F.col(actual), F.col(predicted)).alias("mape"))


def rmse(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    return df.groupBy(*keys).agg(rmse_of(F.col(actual), F.col(predicted)).alias("rmse"))


def null_share(columns: list[str] = EXTERNAL_FEATURES, among: Column | None = None) -> Column:
    """Share of missing external features; 1 when there are no rows."""
    among = F.lit(True) if among is None else among
    missing = sum((F.count_if(among & F.col(c).isNull()) for c in columns[1:]),
                  F.count_if(among & F.col(columns[0]).isNull()))
    return F.coalesce(F.try_divide(missing.cast("double"), F.count_if(among) * len(columns)), F.lit(1.0))


def null_fraction(df: DataFrame, keys: list[str], columns: list[str] = EXTERNAL_FEATURES) -> DataFrame:
    return df.groupBy(*keys).agg(null_share(columns).alias("external_null_frac"))


def split_holdout(daily: DataFrame, horizon: int = HOLDOUT_ROWS, extra: list[str] | None = None) -> DataFrame:
    """Adds ``back`` and ``holdout`` (the newest ``horizon`` rows of each series)."""
    return newest_first(daily, *(extra or [])).drop("_week_ago").withColumn("holdout", F.col("back") <= horizon)


def choose_model(baseline: Column, boosted: Column, null_frac: Column, limit: float = NULL_LIMIT) -> Column:
    """Baseline on stale signals, missing model or tie; otherwise the smaller error."""
    return (
        F.when(null_frac > limit, BASELINE).when(boosted.isNull(), BASELINE).when(baseline.isNull(), BOOSTED)
        .when(boosted < baseline, BOOSTED).otherwise(BASELINE)
    )


def backtest_baseline(gold: DataFrame, horizon: int = HOLDOUT_ROWS) -> DataFrame:
    """Baseline error and missing-signal share on the holdout, one row per series.

    The holdout of a series is at most ``horizon`` values, so it travels as a short array beside the
    history statistics and no second pass over the rows is needed.
    """
    held = F.col("back") <= horizon
    holdout = F.collect_list(F.when(held, F.struct("back", "quantity")))
    per_series = newest_first(gold, *EXTERNAL_FEATURES).groupBy(*SERIES).agg(
        *history_columns(skip=horizon), null_share(among=held).alias("external_null_frac"),
        holdout.alias("holdout"))
    scored = per_series.withColumn("_held", F.size("holdout")).select(
        *SERIES, "external_null_frac", "rows", "tail_mean", "last_week", "_held", F.explode("holdout").alias("_h"))
    step = F.col("_held") - F.col("_h.back") + 1
    scored = scored.withColumn("yhat", clamp(naive_value(step), 0))
    return scored.groupBy(*SERIES).agg(
        F.max("rows").alias("train_rows"),
        mape_of(F.col("_h.quantity"), F.col("yhat")).alias("mape_baseline"),
        F.max("external_null_frac").alias("external_null_frac"))


def backtest(gold: DataFrame, boosted_scores: DataFrame | None = None, horizon: int = HOLDOUT_ROWS) -> DataFrame:
    """Both candidates on the same holdout; ``boosted_scores`` carry (user_id, sku, mape_boosted)."""
    scored = backtest_baseline(gold, horizon)
    if boosted_scores is None:
        scored = scored.withColumn("mape_boosted", F.lit(None).cast("double"))
    else:
        scored = scored.join(boosted_scores, SERIES, "left")
    return scored.withColumn("chosen", choose_model(
        F.col("mape_baseline"), F.col("mape_boosted"), F.col("external_null_frac")))
