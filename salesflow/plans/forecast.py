"""Future context, inference rows, model dispatch and published forecast rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesflow.operators.features import LAGS, ROLLS, add_calendar_parts, default_signals
from salesflow.operators.keyed import latest
from salesflow.plans import baseline
from salesflow.plans.selection import BOOSTED
from salesflow.schemas import FEATURES, SERIES

HORIZON = 30


def in_window(df: DataFrame, start: Column, horizon: int = HORIZON, day: str = "date") -> DataFrame:
    """Rows from ``start`` to ``start + horizon - 1``."""
    return df.filter((F.col(day) >= start) & (F.col(day) <= F.date_add(start, horizon - 1)))


def merge_context(calendar: DataFrame, weather: DataFrame, events: DataFrame) -> DataFrame:
    """Future days of a tenant that have any of the three signals."""
    keys = ["user_id", "date"]
    return (
        calendar.select(*keys, "is_holiday", "days_to_holiday", "is_school_break")
        .join(weather.select(*keys, "temp_avg", "precip_mm"), keys, "full")
        .join(events.select(*keys, "event_count", "large_event_count"), keys, "full")
    )


def carry_last(context: DataFrame, trends: DataFrame) -> DataFrame:
    """Latest interest of the tenant on every context row, even if that value is missing."""
    newest = latest(trends.select("user_id", "date", "interest"), ["user_id"], ["date"])
    return context.join(newest.select("user_id", F.col("interest").alias("trends_interest")), "user_id", "left")


def future_context(calendar: DataFrame, weather: DataFrame, events: DataFrame, trends: DataFrame,
                   start: Column, horizon: int = HORIZON) -> DataFrame:
    merged = merge_context(*[in_window(df, start, horizon) for df in (calendar, weather, events)])
    return carry_last(merged, trends)


def history_arrays(daily: DataFrame) -> DataFrame:
    """Quantities of a series in date order; one value per calendar day at most."""
    ordered = F.array_sort(F.collect_list(F.struct("date", "quantity")))
    return daily.groupBy(*SERIES).agg(F.transform(ordered, lambda x: x["quantity"]).alias("history"))


def with_history(models: DataFrame, history: DataFrame) -> DataFrame:
    """Models of series that have any history."""
    return models.join(history, SERIES)


def tail(history: Column, n: int) -> Column:
    """The last ``n`` values of an array."""
    return F.slice(history, F.greatest(F.size(history) - n + 1, F.lit(1)), F.lit(n))


def inference_features(history: Column, date: str = "date") -> dict[str, Column]:
    """Momentum features read off the end of a history array."""
    out = {f"lag_{n}": F.try_element_at(history, F.lit(-n)) for n in LAGS}
    for n in ROLLS:
        last = tail(history, n)
        total = F.aggregate(last, F.lit(0.0), lambda a, x: a + x)
        out[f"roll_mean_{n}"] = F.try_divide(total, F.size(last))
    return out


def with_context(days: DataFrame, context: DataFrame) -> DataFrame:
    """Tenant context onto series days, defaults where there is none."""
    return default_signals(days.join(context, ["user_id", "date"], "left"))


def inference_rows(series_days: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Feature vector of a future day from (user_id, sku, date, history) and the tenant context."""
    rows = default_signals(series_days) if context is None else with_context(series_days, context)
    rows = add_calendar_parts(rows.withColumns(inference_features(F.col("history"))))
    if "promo_flag" not in rows.columns:
        rows = rows.withColumn("promo_flag", F.lit(False))
    return rows.select(*SERIES, "date", *FEATURES)


def latest_models(metrics: DataFrame) -> DataFrame:
    """Newest training result per series; equal times are decided by the run id."""
    return latest(metrics, SERIES, ["trained_at", "model_run_id"])


def dispatch(models: DataFrame, stats: DataFrame, start: Column, horizon: int = HORIZON,
             boosted: DataFrame | None = None) -> DataFrame:
    """Forecast points per series: the boosted ones where chosen and present, else the baseline.

    ``stats`` are history statistics per series; ``boosted`` carries finished points
    (user_id, sku, date, yhat, yhat_lower, yhat_upper).
    """
    chosen = stats.join(models.select(*SERIES, "chosen"), SERIES)
    if boosted is None:
        return baseline.points(chosen, start, horizon)
    done = boosted.select(*SERIES).distinct().withColumn("_done", F.lit(True))
    use_model = (F.col("chosen") == BOOSTED) & F.coalesce("_done", F.lit(False))
    chosen = chosen.join(done, SERIES, "left").withColumn("_use", use_model)
    picked = boosted.join(chosen.filter("_use").select(*SERIES), SERIES, "left_semi")
    return baseline.points(chosen.filter("not _use"), start, horizon).unionByName(picked)


def forecast_rows(points: DataFrame, models: DataFrame, run_id: Column, generated_at: Column) -> DataFrame:
    """Publishable forecasts: two decimals, one batch id for the whole run."""
    return points.join(models.select(*SERIES, "model_version", "mape_backtest"), SERIES).select(
        *SERIES, F.col("date").alias("forecast_date"), run_id.alias("model_run_id"), "model_version",
        *[F.round(c, 2).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")],
        "mape_backtest", generated_at.alias("generated_at"))


def factor_rows(models: DataFrame, run_id: Column, shown: int = 5) -> DataFrame:
    """Publishable factors from the factors array of the training metrics."""
    entries = models.filter("factors is not null").select(*SERIES, F.explode(F.slice("factors", 1, shown)).alias("_f"))
    return entries.select(*SERIES, run_id.alias("model_run_id"), "_f.factor", "_f.importance", "_f.direction")
