"""Boosted quantile model on Spark ML: one distributed fit over all series.

Quantities are divided by the recent level of their series, its mean over the last 28 rows, so that
series of all sizes share the trees and a trend carries on beyond the training range. The trees are fitted on
four of five rows. The errors of the fifth, in units of their series' usual error, are kept per tree and leaf, and a row's
10 %, 50 % and 90 % points are read from the weighted union of its leaves: its median and a band of its own. A model of
one's own without leaves has the residual quantiles of each series as its band.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cached_property
from typing import Protocol

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from salesflow.functions.scalars import middle_of_three
from salesflow.plans.forecast import inference_features
from salesflow.plans.selection import HOLDOUT_ROWS, mape_of
from salesflow.plans.trees import LeafErrors, Tree, folded, leaf_array, leaf_errors, path_credits, path_table, shares_of_credit
from salesflow.schemas import FEATURES, MOMENTUM_FEATURES, SERIES
from salesflow.session import discard, materialize

MIN_TRAIN_ROWS = 60
KEPT_HISTORY = 28  # the longest lag and window
STEPS_PER_CUT = 5
QUANTILES = (0.1, 0.9)
KEPT_BACK = 5  # one row of so many is not fitted on but tells the errors
PRIOR_ROWS = 20  # a series' usual error starts from that of all series, counted as so many rows
NODES_IN_EXPRESSION = 1000  # a larger model is applied day by day

# Value of a missing feature, outside its range, so that trees can tell it apart.
MISSING = {f: -1.0 for f in FEATURES} | {"temp_avg": -999.0, "days_to_holiday": 99.0}


class Fitted(Protocol):
    """A fitted point model: adds ``prediction`` in units of ``level``."""

    def transform(self, rows: DataFrame) -> DataFrame: ...

    def importances(self) -> dict[str, float]: ...


class Estimator(Protocol):
    """A pluggable model: fitted on rows with FEATURES and ``target``."""

    def fit(self, rows: DataFrame) -> Fitted: ...


def level_of(recent: Column, scale: Column) -> Column:
    """Recent level of the series; its overall mean while there is none."""
    return F.when(recent > 0, recent).otherwise(scale)


def with_level(rows: DataFrame) -> DataFrame:
    return rows.withColumn("level", level_of(F.col("roll_mean_28"), F.col("scale")))


def inputs(feature: Callable[[str], Column], level: Column) -> dict[str, Column]:
    """Model inputs from the features: momentum in units of ``level``, missing values marked."""
    out = {}
    for f in FEATURES:
        value = feature(f).cast("double")
        out[f] = F.coalesce(value / level if f in MOMENTUM_FEATURES else value, F.lit(MISSING[f]))
    return out


def assemble(rows: DataFrame) -> DataFrame:
    """Feature vector of rows with ``level``."""
    columns = {f"_x_{f}": c for f, c in inputs(F.col, F.col("level")).items()}
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(
        rows.withColumns(columns)).drop(*columns)


@dataclass
class FittedTrees:
    model: GBTRegressionModel

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds prediction, and leaves: the number of the row's leaf in each tree."""
        done = self.model.copy().setLeafCol("_leaf").transform(assemble(rows))
        return done.withColumn("leaves", vector_to_array("_leaf").cast("array<int>")).drop("features", "_leaf")

    @cached_property
    def trees(self) -> list[Tree]:
        return [Tree.of_node(t._java_obj.rootNode()) for t in self.model.trees]

    @property
    def weights(self) -> list[float]:
        return [float(w) for w in self.model.treeWeights]

    @property
    def most_leaves(self) -> int:
        return max(t.feature.count(-1) for t in self.trees)

    @property
    def nodes(self) -> int:
        return int(self.model.totalNumNodes)

    def column(self, values: dict[str, Column]) -> Column:
        """The prediction as one expression over the model inputs."""
        ordered = [values[f] for f in FEATURES]
        parts = [F.lit(w) * t.column(ordered) for w, t in zip(self.weights, self.trees)]
        return sum(parts[1:], parts[0])

    def leaf_column(self, values: dict[str, Column]) -> Column:
        return leaf_array(self.trees, [values[f] for f in FEATURES])

    def residuals(self, target: Column, leaves: Column) -> Column:
        """What the trees before each tree leave of the target."""
        size = self.most_leaves
        values = [[w * t.value[path[-1]] for path in t.leaf_paths()] for w, t in zip(self.weights, self.trees)]
        held = folded([x for own in values for x in own + [0.0] * (size - len(own))], "array<double>")
        taken = F.transform(leaves, lambda leaf, t: F.get(held, t * size + leaf))

        def step(acc: Column, value: Column) -> Column:
            return F.struct((acc["r"] - value).alias("r"), F.concat(acc["all"], F.array(acc["r"])).alias("all"))

        first = F.struct(target.alias("r"), F.array().cast("array<double>").alias("all"))
        return F.aggregate(taken, first, step, lambda acc: acc["all"])

    def importances(self) -> dict[str, float]:
        return dict(zip(FEATURES, (float(w) for w in self.model.featureImportances.toArray())))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> "FittedTrees":
        return FittedTrees(GBTRegressionModel.load(path))


@dataclass
class BoostedTrees:
    """Gradient-boosted trees with absolute loss: ``trees`` rounds of at most 2 ** ``depth`` leaves at rate ``step``."""

    trees: int = 12
    depth: int = 4
    step: float = 0.1
    bins: int = 32
    min_leaf: int = 10
    seed: int = 42

    def fit(self, rows: DataFrame) -> FittedTrees:
        learner = GBTRegressor(
            featuresCol="features", labelCol="target", lossType="absolute", maxIter=self.trees, maxDepth=self.depth,
            stepSize=self.step, maxBins=self.bins, minInstancesPerNode=self.min_leaf, seed=self.seed,
            cacheNodeIds=True, checkpointInterval=10)
        return FittedTrees(learner.fit(assemble(rows).select("features", "target")))


def scales(rows: DataFrame) -> DataFrame:
    """Mean quantity and row count of each series; a series without sales gets scale one."""
    return rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("train_rows"), F.avg("quantity").alias("_mean")).select(
        *SERIES, "train_rows", F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(1.0).alias("scale"))


def trainable(rows: DataFrame, scale: DataFrame) -> DataFrame:
    """Rows of series with enough history, with the scaled target."""
    enough = scale.filter(F.col("train_rows") >= MIN_TRAIN_ROWS)
    return with_level(rows.filter("quantity is not null").join(enough, SERIES)).withColumn(
        "target", F.col("quantity") / F.col("level"))


def residual_bands(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """Residual quantiles per series, in units of its level, with its scale."""
    residual = F.col("target") - F.col("prediction")
    return fitted.transform(rows).groupBy(*SERIES).agg(
        F.percentile(residual, F.array(*map(F.lit, QUANTILES))).alias("_q"), F.first("scale").alias("scale")).select(
        *SERIES, "scale", F.col("_q")[0].alias("q_low"), F.col("_q")[1].alias("q_high"))


def guard_crossing(low: Column, mid: Column, high: Column) -> dict[str, Column]:
    trio = middle_of_three(low, mid, high)
    return {"yhat_lower": F.get(trio, F.lit(0)), "yhat": F.get(trio, F.lit(1)), "yhat_upper": F.get(trio, F.lit(2))}


def band_of(low: Column, mid: Column, high: Column, level: Column) -> dict[str, Column]:
    """yhat and its band, at least zero and in order."""
    value = lambda c: F.greatest(c * level, F.lit(0.0))
    return guard_crossing(value(low), value(mid), value(high))


@dataclass
class QuantileModel:
    """A fitted point model and what gives its bands.

    ``bands`` has a row per series: its scale, and its usual error (spread) where ``errors`` hold the leaves' errors in units of
    it, else its residual quantiles (q_low, q_high).
    """

    fitted: Fitted
    bands: DataFrame
    errors: LeafErrors | None = None

    def band(self, prediction: Column, level: Column, quantiles: Column | None = None) -> dict[str, Column]:
        """The band of a prediction; ``quantiles`` are those of the row's leaves."""
        if self.errors is None:
            return band_of(prediction + F.col("q_low"), prediction, prediction + F.col("q_high"), level)
        return band_of(*[prediction + F.get(quantiles, F.lit(i)) * F.col("spread") for i in range(3)], level)

    def banded(self, predicted: DataFrame) -> DataFrame:
        """Rows that ``fitted`` has transformed, with yhat, yhat_lower and yhat_upper."""
        if self.errors is not None:
            predicted = predicted.withColumn("_q", self.errors.quantiles(F.col("leaves")))
        return predicted.withColumns(self.band(F.col("prediction"), F.col("level"), F.col("_q") if self.errors else None)).drop("_q")

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows of known series with yhat, yhat_lower and yhat_upper."""
        return self.banded(self.fitted.transform(with_level(rows.join(self.bands, SERIES))))

    def save(self, path: str) -> None:
        self.fitted.save(f"{path}/trees")
        self.bands.write.mode("overwrite").parquet(f"{path}/bands")
        kept = [asdict(self.errors)] if self.errors else []
        self.bands.sparkSession.createDataFrame(kept, ERRORS).write.mode("overwrite").parquet(f"{path}/errors")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "QuantileModel":
        kept = spark.read.schema(ERRORS).parquet(f"{path}/errors").first()
        return QuantileModel(FittedTrees.load(f"{path}/trees"), spark.read.parquet(f"{path}/bands"), LeafErrors(**kept.asDict()) if kept else None)


ERRORS = "weights array<double>, leaves int, grid array<double>, shares array<double>"


def kept_back() -> Column:
    """One row in KEPT_BACK, the same ones in each run."""
    return F.pmod(F.xxhash64(*SERIES, "date"), F.lit(KEPT_BACK)) == 0


def honest_errors(fitted: FittedTrees, rows: DataFrame, held: DataFrame) -> tuple[DataFrame, LeafErrors]:
    """Scale and usual error of each series of ``rows``, and the errors of ``held`` per leaf in units of it."""
    found = materialize(fitted.transform(held).select(*SERIES, "leaves", (F.col("target") - F.col("prediction")).alias("residual")), "residuals")
    usual = found.agg(F.avg(F.abs("residual")).alias("u")).first().u or 1.0
    own = found.groupBy(*SERIES).agg(F.sum(F.abs("residual")).alias("a"), F.count(F.lit(1)).alias("n"))
    spread = (F.coalesce("a", F.lit(0.0)) + PRIOR_ROWS * usual) / (F.coalesce("n", F.lit(0)) + PRIOR_ROWS)
    series = rows.groupBy(*SERIES).agg(F.first("scale").alias("scale"))
    bands = materialize(series.join(own, SERIES, "left").select(*SERIES, "scale", spread.alias("spread")), "bands")
    errors = found.join(bands, SERIES).select("leaves", (F.col("residual") / F.col("spread")).alias("error"))
    counted = leaf_errors(errors, fitted.weights, fitted.most_leaves)
    discard(found)
    return bands, counted


def fit_quantiles(rows: DataFrame, estimator: Estimator | None = None) -> QuantileModel:
    """Fit on all rows of series with at least sixty of them."""
    train = trainable(rows, scales(rows))
    estimator = estimator or BoostedTrees()
    if not isinstance(estimator, BoostedTrees):
        fitted = estimator.fit(train)
        return QuantileModel(fitted, materialize(residual_bands(fitted, train), "bands"))
    fitted = estimator.fit(train.filter(~kept_back()))
    return QuantileModel(fitted, *honest_errors(fitted, train, train.filter(kept_back())))


def boosted_scores(gold: DataFrame, estimator: Estimator | None = None, horizon: int = HOLDOUT_ROWS) -> DataFrame:
    """Error of the boosted model on the holdout of each series; none for series with little history.

    ``gold`` carries ``back`` (1 = newest row of the series).
    """
    model = fit_quantiles(gold.filter(F.col("back") > horizon), estimator)
    scored = model.predict(gold.filter(F.col("back") <= horizon))
    return scored.groupBy(*SERIES).agg(mape_of(F.col("quantity"), F.col("yhat")).alias("mape_boosted"))


def importance_table(series: DataFrame, fitted: Fitted) -> DataFrame:
    """Feature weights of a model shared by all series, one row per series and feature."""
    entries = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(w).alias("importance"))
                        for f, w in fitted.importances().items()])
    return series.select(*SERIES, F.explode(entries).alias("_e")).select(*SERIES, "_e.factor", "_e.importance")


def series_importances(rows: DataFrame, model: QuantileModel) -> DataFrame:
    """Share of each feature in the error that the model's splits take from the rows of each series: (*SERIES, factor, importance).

    A model of one's own without trees has the same weights for all series.
    """
    known = rows.filter("quantity is not null").join(model.bands, SERIES)
    if not isinstance(model.fitted, FittedTrees):
        return importance_table(known.select(*SERIES).distinct(), model.fitted)
    target = with_level(known).withColumn("target", F.col("quantity") / F.col("level"))
    placed = model.fitted.transform(target)
    steps = placed.select(*SERIES, "leaves", model.fitted.residuals(F.col("target"), F.col("leaves")).alias("residuals"))
    paths = path_table(rows.sparkSession, model.fitted.trees, model.fitted.weights, FEATURES)
    return shares_of_credit(path_credits(steps, paths, SERIES), SERIES, FEATURES)


_CONTEXT = ["is_holiday", "days_to_holiday", "is_school_break", "temp_avg", "precip_mm", "trends_interest",
            "event_count", "large_event_count"]


def context_arrays(context: DataFrame, tenants: DataFrame, start: Column, horizon: int) -> DataFrame:
    """The context of each tenant as one array over the days of the horizon, missing days as defaults."""
    from salesflow.plans.forecast import with_context

    days = tenants.select("user_id").distinct().withColumn("_start", start).select(
        "user_id", F.explode(F.sequence("_start", F.date_add("_start", horizon - 1))).alias("date"))
    rows = with_context(days, context)
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("date", *_CONTEXT))).alias("_days"))


_POINTS = "array<struct<date:date,yhat:double,yhat_lower:double,yhat_upper:double>>"


def series_state(model: QuantileModel, daily: DataFrame, context: DataFrame, start: Column, horizon: int) -> DataFrame:
    """One row per series: its last 28 values, its bands and the days of the horizon with their context."""
    newest = Window.partitionBy(*SERIES).orderBy(F.desc("date"))
    tail = daily.withColumn("_b", F.row_number().over(newest)).filter(F.col("_b") <= KEPT_HISTORY)
    history = tail.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("date", "quantity"))).alias("_h")).select(
        *SERIES, F.col("_h.quantity").alias("history"))
    return history.join(model.bands, SERIES).join(context_arrays(context, daily, start, horizon), "user_id", "left")


def day_features(history: Column, day: Column) -> dict[str, Column]:
    """All features of a day of the horizon."""
    return {
        **inference_features(history), "dow": F.weekday(day["date"]), "month": F.month(day["date"]),
        "is_weekend": F.weekday(day["date"]) >= 5, "promo_flag": F.lit(False), **{c: day[c] for c in _CONTEXT}}


def longer(history: Column, value: Column) -> Column:
    """History with one more value, cut to the part that later days need."""
    grown = F.concat(history, F.array(value))
    return F.slice(grown, F.greatest(F.size(grown) - KEPT_HISTORY + 1, F.lit(1)), F.lit(KEPT_HISTORY))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def recursive_forecast(model: QuantileModel, daily: DataFrame, context: DataFrame, start: Column,
                       horizon: int = 30) -> DataFrame:
    """Day by day forecast that feeds each median back into lags and means.

    A model that can be written as an expression runs in one pass: a fold over the days of each series.
    Any other model is applied to all series once per day.
    """
    state = series_state(model, daily, context, start, horizon)
    if not hasattr(model.fitted, "column") or getattr(model.fitted, "nodes", 0) > NODES_IN_EXPRESSION:
        return forecast_stepwise(model, state, horizon)

    def step(acc: Column, day: Column) -> Column:
        names = {f: c for f, c in day_features(acc["history"], day).items()}
        features = F.struct(*[c.alias(f) for f, c in names.items()])

        def predict(f: Column) -> Column:
            level = level_of(f["roll_mean_28"], F.col("scale"))
            filled = inputs(lambda name: f[name], level)
            vector = F.struct(level.alias("level"), *[c.alias(name) for name, c in filled.items()])
            def placed(x: Column) -> Column:
                values = {name: x[name] for name in FEATURES}
                union = [] if model.errors is None else [model.errors.quantiles(model.fitted.leaf_column(values)).alias("q")]
                return F.struct(x["level"].alias("level"), model.fitted.column(values).alias("p"), *union)

            return bind(vector, placed)

        def append(p: Column) -> Column:
            band = model.band(p["p"], p["level"], None if model.errors is None else p["q"])
            point = F.struct(day["date"].alias("date"), *[band[c].alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")])
            return bind(point, lambda q: F.struct(
                longer(acc["history"], q["yhat"]).alias("history"), F.concat(acc["points"], F.array(q)).alias("points")))

        return bind(bind(features, predict), append)

    first = F.struct(F.col("history"), F.array().cast(_POINTS).alias("points"))
    done = state.select(*SERIES, F.aggregate("_days", first, step, lambda acc: acc["points"]).alias("_points"))
    return done.select(*SERIES, F.explode("_points").alias("_p")).select(*SERIES, "_p.*")


def forecast_stepwise(model: QuantileModel, state: DataFrame, horizon: int) -> DataFrame:
    """The same recursion with the model applied to all series once per day, each day a narrow projection.

    The state is written to the shared folder every few days to keep the plan short.
    """
    kept = [*model.bands.columns, "history", "_days", "points"]
    state = materialize(state.withColumn("points", F.array().cast(_POINTS)).select(*kept), "state")
    for step in range(horizon):
        rows = state.withColumn("_day", F.get("_days", F.lit(step)))
        rows = rows.withColumns(day_features(F.col("history"), F.col("_day")))
        done = model.banded(model.fitted.transform(with_level(rows)))
        point = F.struct(F.col("_day.date").alias("date"), "yhat", "yhat_lower", "yhat_upper")
        state = done.withColumns({
            "points": F.concat("points", F.array(point)), "history": longer(F.col("history"), F.col("yhat"))}).select(*kept)
        # The last cut also keeps the filter that explode infers from running back through every step.
        if (step + 1) % STEPS_PER_CUT == 0 or step == horizon - 1:
            state = materialize(state, "state")
    return state.select(*SERIES, F.explode("points").alias("_p")).select(*SERIES, "_p.*")


def forecast_each(gold: DataFrame, model: Callable, schema: str) -> DataFrame:
    """A caller's own per-series model: ``model(pandas rows of one series) -> pandas rows``.

    A series holds at most one row per calendar day. The built-in operators do not use this path.
    """
    return gold.groupBy(*SERIES).applyInPandas(model, schema)
