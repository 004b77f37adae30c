"""Silver to Gold: positional lags, trailing means, calendar parts and the signal join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from salesflow.functions.scalars import dow, is_weekend
from salesflow.operators.silver import by_series
from salesflow.schemas import SERIES_DAY

LAGS = [1, 7, 14, 28]
ROLLS = [7, 28]


def add_calendar_parts(df: DataFrame, day: str = "date") -> DataFrame:
    return df.withColumns({
        "dow": dow(F.col(day)), "month": F.month(day), "is_weekend": is_weekend(F.col(day)),
    })


def lag_columns(lags: list[int] = LAGS) -> dict[str, Column]:
    """Quantity n rows ago: rows, not days, so holes in the calendar do not shift to NULL."""
    return {f"lag_{n}": F.lag("quantity", n).over(by_series()) for n in lags}


def roll_columns(windows: list[int] = ROLLS) -> dict[str, Column]:
    """Mean of the up to n rows before the current one."""
    return {f"roll_mean_{n}": F.avg("quantity").over(by_series().rowsBetween(-n, -1)) for n in windows}


def add_lags(df: DataFrame, lags: list[int] = LAGS) -> DataFrame:
    return df.withColumns(lag_columns(lags))


def add_rolls(df: DataFrame, windows: list[int] = ROLLS) -> DataFrame:
    return df.withColumns(roll_columns(windows))


def signal_days(weather: DataFrame | None = None, calendar: DataFrame | None = None,
                trends: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame | None:
    """All signals of a tenant and day on one row; inputs are unique per (user_id, date)."""
    parts = [
        (weather, ["temp_avg", "precip_mm"]),
        (calendar, ["is_holiday", "days_to_holiday", "is_school_break"]),
        (trends, [F.col("interest").alias("trends_interest")]),
        (events, ["event_count", "large_event_count"]),
    ]
    merged = None
    for df, columns in parts:
        if df is None:
            continue
        part = df.select("user_id", "date", *columns)
        merged = part if merged is None else merged.join(part, ["user_id", "date"], "full")
    return merged


# Type and default of each signal column on a day without that signal.
_SIGNAL_DEFAULTS = [
    ("is_holiday", "boolean", False), ("days_to_holiday", "int", None), ("is_school_break", "boolean", False),
    ("temp_avg", "double", None), ("precip_mm", "double", None), ("trends_interest", "double", None),
    ("event_count", "bigint", 0), ("large_event_count", "bigint", 0),
]


def default_signals(df: DataFrame) -> DataFrame:
    """Every signal column present, typed, with its default where the signal is missing."""
    filled = {}
    for name, kind, default in _SIGNAL_DEFAULTS:
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        filled[name] = value if default is None else F.coalesce(value, F.lit(default).cast(kind))
    return df.withColumns(filled)


def join_signals(sales: DataFrame, weather: DataFrame | None = None, calendar: DataFrame | None = None,
                 trends: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Signals onto sales days.

    The signals are merged per tenant and day first, so the large side meets one join. The day in the
    key spreads a large tenant over its days.
    """
    signals = signal_days(weather, calendar, trends, events)
    joined = sales if signals is None else sales.join(signals, ["user_id", "date"], "left")
    return default_signals(joined)


def gold_features(silver: DataFrame, weather: DataFrame | None = None, calendar: DataFrame | None = None,
                  trends: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Model-ready rows, one per series and sales day."""
    rows = silver.withColumns({**lag_columns(), **roll_columns()})
    rows = join_signals(add_calendar_parts(rows), weather, calendar, trends, events)
    return rows.select(
        *SERIES_DAY, "quantity", "dow", "month", "is_weekend", "promo_flag", "gap_flag",
        *[f"lag_{n}" for n in LAGS], *[f"roll_mean_{n}" for n in ROLLS],
        *[name for name, _, _ in _SIGNAL_DEFAULTS],
    )
