"""Factor attribution: direction by correlation, top factors by normalised weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from salesflow.operators.keyed import top_n
from salesflow.schemas import FEATURES, MOMENTUM_FEATURES, SERIES

MIN_PAIRS = 10
NEUTRAL = 0.05
SHOWN = 5


def direction_of(pairs: Column, r: Column) -> Column:
    return F.when(pairs < MIN_PAIRS, "neutral").when(r > NEUTRAL, "up").when(r < -NEUTRAL, "down").otherwise("neutral")


def directions(rows: DataFrame, keys: list[str] = SERIES, features: list[str] = FEATURES,
               target: str = "quantity") -> DataFrame:
    """Direction of each feature per key: sign of its Pearson correlation with the target.

    Features become rows ahead of the aggregation. They are summed up again before the shuffle, and
    one narrow aggregate stays in generated code where one per feature, side by side, would not.
    Without variance on either side r is NULL, hence neutral.
    """
    entries = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in features])
    pairs = rows.filter(F.col(target).isNotNull()).select(
        *keys, F.col(target).alias("_y"), F.explode(entries).alias("_e"))
    x, y = F.col("_e.x"), F.when(F.col("_e.x").isNotNull(), F.col("_y"))
    summed = pairs.groupBy(*keys, F.col("_e.factor").alias("factor")).agg(
        F.count(x).alias("_pairs"), F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))).alias("_r"))
    return summed.select(*keys, "factor", direction_of(F.col("_pairs"), F.col("_r")).alias("direction"))


def normalise(df: DataFrame, keys: list[str], weight: str = "importance", digits: int = 4) -> DataFrame:
    """Share of each weight in its group, a zero total read as one."""
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return df.withColumn(weight, F.round(F.col(weight) / F.when(total == 0, 1.0).otherwise(total), digits))


def feature_position(factor: Column) -> Column:
    """Place in the feature list: decides between equal weights."""
    return F.array_position(F.array(*[F.lit(f) for f in FEATURES]), factor)


def top_factors(importances: DataFrame, rows: DataFrame, keys: list[str] = SERIES, k: int = SHOWN,
                exclude: list[str] = MOMENTUM_FEATURES) -> DataFrame:
    """Strongest non-momentum factors per series with their share and direction.

    ``importances`` carry (*keys, factor, importance).
    """
    candidates = importances.filter((F.col("importance") > 0) & ~F.col("factor").isin(exclude))
    shown = top_n(candidates, keys, [F.desc("importance"), feature_position(F.col("factor"))], k, position="rank")
    features = [f for f in FEATURES if f not in exclude]
    return normalise(shown, keys).join(directions(rows, keys, features), [*keys, "factor"], "left").select(
        *keys, "factor", "importance", F.coalesce("direction", F.lit("neutral")).alias("direction"), "rank")
