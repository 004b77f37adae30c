"""Leaves and paths of trees against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from salesflow.catalog.trees import TREES
from salesflow.plans import model
from salesflow.plans.trees import Tree, leaf_array, leaf_errors, path_credits, path_table, shares_of_credit
from salesflow.schemas import FEATURES, SERIES


def test_leaves_are_numbered_from_left_to_right(spark):
    tree = TREES[0]
    assert [p[-1] for p in tree.leaf_paths()] == [2, 3, 5, 6]
    rows = spark.createDataFrame([(20.0, 1.0, 5.0), (20.0, 6.0, 5.0), (30.0, 1.0, 30.0), (30.0, 1.0, 31.0), (None, 1.0, None)],
                                 "roll_mean_7 double, dow double, lag_7 double")
    values = [F.col(f) if f in rows.columns else F.lit(None).cast("double") for f in FEATURES]
    got = rows.select(tree.column(values).alias("v"), leaf_array([tree], values).alias("l")).collect()
    assert [(r.v, r.l) for r in got] == [(0.75, [0]), (1.0, [1]), (1.125, [2]), (1.5, [3]), (1.5, [3])]  # missing goes right


def union_quantile(errors, leaves, weights, grid, q):
    """Smallest grid point at which the weighted shares of the leaves' errors reach q."""
    for g in grid:
        total = 0.0
        for t, leaf in enumerate(leaves):
            own = [e for held, e in errors if held[t] == leaf] or [e for _, e in errors]
            total += weights[t] * sum(e <= g or g == grid[-1] for e in own) / len(own)
        if total >= q * sum(weights) - 1e-9:
            return g


def test_quantiles_of_the_union_of_leaves(spark):
    rnd = random.Random(2)
    errors = [([rnd.randrange(3), rnd.randrange(2)], rnd.gauss(0, 1) * 2) for _ in range(400)]
    errors = [(leaves, e + 4 * leaves[0]) for leaves, e in errors]
    df = spark.createDataFrame(errors, "leaves array<int>, error double").repartition(3)
    grid, weights = [float(g) for g in range(-6, 13)], [1.0, 0.25]
    found = leaf_errors(df, weights, 4, grid=grid)
    asked = spark.createDataFrame([([a, b],) for a in range(4) for b in range(2)], "leaves array<int>")  # leaf 3 has no error of its own
    for r in asked.select("leaves", found.quantiles(F.col("leaves")).alias("q")).collect():
        assert r.q == [union_quantile(errors, r.leaves, weights, grid, q) for q in (0.1, 0.5, 0.9)]
    own = leaf_errors(df, weights, 4)
    assert own.grid == sorted(own.grid) and len(own.grid) <= 64 and own.grid[-1] == max(e for _, e in errors)
    assert leaf_errors(df.limit(0), weights, 2).quantiles is not None


def test_credits_add_up_to_what_the_splits_take(spark):
    rnd = random.Random(4)
    values = lambda path, tree: [tree.value[n] for n in path]
    rows, want = [], {}
    for i in range(200):
        key, leaves = f"s{i % 3}", [rnd.randrange(4), rnd.randrange(3)]
        targets = [tree.value[tree.leaf_paths()[leaf][-1]] + rnd.gauss(0, 0.1) for tree, leaf in zip(TREES, leaves)]
        rows.append((key, leaves, targets))
        for tree, leaf, y, w in zip(TREES, leaves, targets, (1.0, 0.5)):
            path = tree.leaf_paths()[leaf]
            for node, before, after in zip(path, values(path, tree), values(path[1:], tree)):
                name = FEATURES[tree.feature[node]]
                want[key, name] = want.get((key, name), 0.0) + abs(y - w * before) - abs(y - w * after)
    df = spark.createDataFrame(rows, "sku string, leaves array<int>, residuals array<double>").repartition(4)
    paths = path_table(spark, TREES, [1.0, 0.5], FEATURES)
    got = {(r.sku, r.factor): r.credit for r in path_credits(df, paths, ["sku"]).collect()}
    assert got == pytest.approx(want)
    shares = shares_of_credit(path_credits(df, paths, ["sku"]), ["sku"], FEATURES).collect()
    assert len(shares) == 3 * len(FEATURES) and all(r.importance >= 0 for r in shares)
    for key in ("s0", "s1", "s2"):
        assert sum(r.importance for r in shares if r.sku == key) == pytest.approx(1.0)


def gold_rows(spark, n=900):
    """Two series: one moved by the weekday, one by the temperature."""
    days = spark.range(n).select(F.explode(F.array(F.lit("week"), F.lit("heat"))).alias("sku"), F.col("id").cast("int").alias("i"))
    dow, heat = F.col("i") % 7, F.pmod(F.xxhash64("i"), F.lit(40)).cast("double")
    quantity = 50 + F.when(F.col("sku") == "week", F.when(dow >= 5, 30.0).otherwise(0.0)).otherwise(F.when(heat > 25, 30.0).otherwise(0.0))
    noise = F.pmod(F.xxhash64("i", "sku"), F.lit(11)) - 5
    rows = days.select(F.lit("u").alias("user_id"), "sku", F.date_add(F.lit("2023-01-01").cast("date"), F.col("i")).alias("date"),
                       (quantity + noise * F.when(dow >= 5, 3.0).otherwise(1.0)).alias("quantity"), dow.alias("dow"), heat.alias("temp_avg"))
    fixed = {f: F.lit(55.0) for f in ("lag_1", "lag_7", "lag_14", "lag_28", "roll_mean_7", "roll_mean_28")}
    return rows.withColumns({**fixed, **{f: F.lit(None).cast("double") for f in FEATURES if f not in (*fixed, "dow", "temp_avg")}})


@pytest.fixture(scope="module")
def fitted(spark):
    rows = gold_rows(spark).cache()
    yield rows, model.fit_quantiles(rows, model.BoostedTrees(trees=20, depth=4))
    rows.unpersist()


def test_spark_ml_and_the_arrays_agree(fitted):
    rows, found = fitted
    train = model.with_level(rows.join(found.bands, SERIES))
    values = model.inputs(F.col, F.col("level"))
    both = found.fitted.transform(train).withColumns({"own": found.fitted.column(values), "mine": found.fitted.leaf_column(values)})
    assert both.filter("abs(own - prediction) > 1e-9 OR mine <> leaves").count() == 0


def test_series_have_their_own_factors(fitted):
    rows, found = fitted
    shares = {(r.sku, r.factor): r.importance for r in model.series_importances(rows, found).collect()}
    assert shares["week", "dow"] > 0.8 and shares["heat", "temp_avg"] > 0.8
    assert sum(v for (sku, _), v in shares.items() if sku == "week") == pytest.approx(1.0)


def pinball(rows, bounds):
    parts = []
    for q, c in zip((0.1, 0.5, 0.9), bounds):
        off = F.col("quantity") - F.col(c)
        parts.append(F.avg(F.greatest(q * off, (q - 1) * off)).alias(f"p{int(100 * q)}"))
    return rows.agg(*parts).first()


def test_bands_follow_the_rows(fitted, spark):
    """Weekends are three times as noisy here: bands of the leaves know, one band per series does not."""
    rows, found = fitted
    fresh = gold_rows(spark, 1800).filter(F.col("date") > "2025-06-19")
    own = found.predict(fresh).withColumn("width", F.col("yhat_upper") - F.col("yhat_lower"))
    week = own.filter("sku = 'week'").groupBy((F.col("dow") >= 5).alias("end")).agg(F.avg("width").alias("w")).collect()
    width = {r.end: r.w for r in week}
    assert width[True] > 1.8 * width[False]
    inside = own.agg(F.avg(F.col("quantity").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("int")).alias("i")).first().i
    assert 0.75 <= inside <= 0.9
    constant = model.QuantileModel(found.fitted, model.residual_bands(found.fitted, model.trainable(rows, model.scales(rows))))
    a, b = pinball(own, ("yhat_lower", "yhat", "yhat_upper")), pinball(constant.predict(fresh), ("yhat_lower", "yhat", "yhat_upper"))
    assert a.p10 < b.p10 and a.p90 < b.p90 and a.p50 < b.p50 + 0.05


def test_model_with_bands_is_saved_and_loaded(fitted, spark, tmp_path):
    rows, found = fitted
    found.save(str(tmp_path / "model"))
    again = model.QuantileModel.load(spark, str(tmp_path / "model"))
    sides = [m.predict(rows.limit(200)).orderBy("sku", "date").select("yhat", "yhat_lower", "yhat_upper").collect() for m in (found, again)]
    assert sides[0] == sides[1]


def test_a_tree_of_one_leaf(spark):
    tree = Tree()
    tree.add(2.5)
    assert spark.range(1).select(tree.column([]).alias("v"), tree.column([], True).alias("n")).first() == (2.5, 0)
