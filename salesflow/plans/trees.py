"""Fitted trees as arrays: their leaves and paths, and what both tell about single rows.

A boosted model's trees give a point. Two things more are read off them here. The rows that share a row's leaves have been
wrong by known amounts: the weighted union of these leaves' errors is the row's own error distribution. And a row's paths
name the splits that moved its prediction: each split is credited with the loss it takes from the rows that pass it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

LEAF = -1
POINTS = 64  # of the grid on which errors are counted
QUANTILES = (0.1, 0.5, 0.9)


@dataclass
class Tree:
    """Nodes in arrays, the root first; a leaf's feature is LEAF. Leaves are numbered from left to right."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float, feature: int = LEAF, threshold: float = 0.0) -> int:
        for column, entry in ((self.feature, feature), (self.threshold, threshold), (self.left, LEAF), (self.right, LEAF), (self.value, value)):
            column.append(entry)
        return len(self.feature) - 1

    @staticmethod
    def of_node(node) -> "Tree":
        """A tree of Spark ML."""
        tree, todo = Tree(), [(node, None, None)]
        while todo:
            at, parent, side = todo.pop()
            inner = at.subtreeDepth() > 0
            here = tree.add(float(at.prediction()), *((at.split().featureIndex(), float(at.split().threshold())) if inner else ()))
            if parent is not None:
                side[parent] = here
            if inner:
                todo += [(at.rightChild(), here, tree.right), (at.leftChild(), here, tree.left)]
        return tree

    def leaf_paths(self) -> list[list[int]]:
        """The nodes from the root to each leaf, in the order of leaves."""
        done, todo = [], [[0]]
        while todo:
            path = todo.pop()
            if self.feature[path[-1]] == LEAF:
                done.append(path)
            else:
                todo += [path + [self.right[path[-1]]], path + [self.left[path[-1]]]]
        return done

    def column(self, values: list[Column], numbers: bool = False) -> Column:
        """The leaf's value, or its number, as nested conditions over the features."""
        number = {path[-1]: i for i, path in enumerate(self.leaf_paths())}

        def at(node: int) -> Column:
            if self.feature[node] == LEAF:
                return F.lit(number[node] if numbers else self.value[node])
            return F.when(values[self.feature[node]] <= self.threshold[node], at(self.left[node])).otherwise(at(self.right[node]))

        return at(0)


def leaf_array(trees: list[Tree], values: list[Column]) -> Column:
    """Number of the leaf in each tree."""
    return F.array(*[t.column(values, True) for t in trees])


def folded(values: list, kind: str) -> Column:
    """A constant array of any length as one literal."""
    return F.from_json(F.lit(json.dumps(values)), kind)


@dataclass
class LeafErrors:
    """Share of errors at or below each point of a grid, per tree and leaf; as large as the model, whatever the rows."""

    weights: list[float]
    leaves: int  # per tree, at most
    grid: list[float]
    shares: list[float]  # by tree, leaf and point

    def quantiles(self, leaves: Column, at: tuple[float, ...] = QUANTILES) -> Column:
        """Quantiles of the weighted union of a row's leaves: for each the first point whose share reaches it."""
        points, total = len(self.grid), sum(self.weights)
        table, weights, grid = folded(self.shares, "array<double>"), folded(self.weights, "array<double>"), folded(self.grid, "array<double>")
        starts = F.transform(leaves, lambda leaf, t: (t * self.leaves + leaf) * points)

        def union(point: Column) -> Column:
            parts = F.zip_with(starts, weights, lambda start, w: F.get(table, start + point) * w)
            return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

        held = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), union)
        below = lambda shares, q: F.aggregate(shares, F.lit(0), lambda n, s: n + (s < q * total - 1e-9).cast("int"))
        return F.get(F.transform(F.array(held), lambda s: F.array(*[F.get(grid, F.least(below(s, q), F.lit(points - 1))) for q in at])), F.lit(0))


def error_grid(errors: DataFrame, points: int = POINTS) -> list[float]:
    """Values that cut all errors (error) into parts of equal size, the last one the largest."""
    cuts = [(i + 1) / points for i in range(points)]
    found = errors.agg(F.percentile_approx("error", F.array(*map(F.lit, cuts)), F.lit(100 * points)).alias("g")).first().g
    return sorted(set(found or [0.0]))


def leaf_errors(errors: DataFrame, weights: list[float], leaves: int, points: int = POINTS, grid: list[float] | None = None) -> LeafErrors:
    """Count errors (leaves, error) on a grid per tree and leaf. A leaf without any has those of all rows.

    Errors above a given grid count at its last point. Rows are counted before the shuffle, so it carries one row per task,
    tree, leaf and point.
    """
    grid = grid or error_grid(errors, points)
    # The place on the grid is that of the first point that is not smaller.
    place = F.aggregate(folded(grid, "array<double>"), F.lit(0), lambda n, g: n + (g < F.col("error")).cast("int"))
    rows = errors.withColumn("p", F.least(place, F.lit(len(grid) - 1))).select("p", F.posexplode("leaves").alias("t", "leaf"))
    counts = rows.groupBy("t", "leaf", "p").agg(F.count(F.lit(1)).alias("n")).collect()  # at most trees x leaves x points
    size = len(grid)
    table = [[[0] * size for _ in range(leaves)] for _ in weights]
    for r in counts:
        table[r.t][r.leaf][r.p] += r.n
    whole = [sum(leaf[p] for leaf in table[0]) for p in range(size)] if table else []
    shares = []
    for tree in table:
        for leaf in tree:
            held = leaf if sum(leaf) else whole if sum(whole) else [1] + [0] * (size - 1)
            run, total = 0, sum(held)
            for n in held:
                run += n
                shares.append(run / total)
    return LeafErrors(list(weights), leaves, grid, shares)


def path_table(spark, trees: list[Tree], weights: list[float], features: list[str]) -> DataFrame:
    """All steps of all paths: t, leaf, factor, weighted value before and after the split. Bounded by the model."""
    rows = [(t, leaf, features[tree.feature[a]], weight * tree.value[a], weight * tree.value[b])
            for t, (tree, weight) in enumerate(zip(trees, weights)) for leaf, path in enumerate(tree.leaf_paths()) for a, b in zip(path, path[1:])]
    return spark.createDataFrame(rows, "t int, leaf int, factor string, before double, after double")


def path_credits(rows: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute error that splits on each factor take from the rows of each key: (*keys, factor, credit).

    ``rows``: keys, ``leaves`` and ``residuals``, what the trees before each tree leave of the row. A step of a row's path changes its
    prediction from one node's value to the next one's, and is credited with the error that this takes; all steps of a row
    add up to what its prediction gains over the roots. The sum of a key may be negative. Sums are taken before the shuffle.
    """
    steps = rows.select(*keys, F.posexplode(F.arrays_zip("leaves", "residuals")).alias("t", "s")).select(
        *keys, "t", F.col("s.leaves").alias("leaf"), F.col("s.residuals").alias("r"))
    # Paths as one row per leaf keep the join one to one.
    listed = paths.groupBy("t", "leaf").agg(F.collect_list(F.struct("factor", "before", "after")).alias("p"))
    joined = steps.join(listed, ["t", "leaf"]).select(*keys, "r", F.explode("p").alias("p")).select(*keys, "r", "p.*")
    return joined.groupBy(*keys, "factor").agg(F.sum(F.abs(F.col("r") - F.col("before")) - F.abs(F.col("r") - F.col("after"))).alias("credit"))


def shares_of_credit(credits: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Credits as shares per key, one row for every feature; a negative credit is none, and without any all are zero."""
    held = credits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("factor", F.greatest("credit", F.lit(0.0)).alias("c")))).alias("m"))
    entries = F.array(*[F.struct(F.lit(f).alias("factor"), F.coalesce(F.col("m").getItem(f), F.lit(0.0)).alias("c")) for f in features])
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["c"])
    flat = held.select(*keys, entries.alias("e")).withColumn("total", total).select(*keys, "total", F.explode("e").alias("x"))
    return flat.select(*keys, F.col("x.factor").alias("factor"), (F.col("x.c") / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)).alias("importance"))
