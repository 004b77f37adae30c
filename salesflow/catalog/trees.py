"""Queries: what the leaves and paths of given trees tell about each row, with the trees written down so that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesflow.catalog.features import gold
from salesflow.catalog.registry import query
from salesflow.plans.trees import LEAF, Tree, leaf_array, leaf_errors, path_credits, path_table, shares_of_credit
from salesflow.schemas import FEATURES, SERIES

GRID = [float(g) for g in range(-45, 46, 3)]
WEIGHTS = [1.0, 0.5]


def tree(*nodes: tuple) -> Tree:
    """(value,) is a leaf, (value, feature, threshold, left, right) a split."""
    out = Tree()
    for value, *split in nodes:
        out.add(value, FEATURES.index(split[0]) if split else LEAF, split[1] if split else 0.0)
    for i, (_, *split) in enumerate(nodes):
        if split:
            out.left[i], out.right[i] = split[2:]
    return out


TREES = [
    tree((1.0, "roll_mean_7", 25.0, 1, 4), (0.875, "dow", 4.0, 2, 3), (0.75,), (1.0,), (1.25, "lag_7", 30.0, 5, 6), (1.125,), (1.5,)),
    tree((0.0, "dow", 2.0, 1, 2), (-0.25,), (0.125, "temp_avg", 50.0, 3, 4), (0.0,), (0.25,)),
]

PATHS = ", ".join(
    f"({t}, {leaf}, '{FEATURES[held.feature[a]]}', {held.value[a]}, {held.value[b]})"
    for t, held in enumerate(TREES) for leaf, path in enumerate(held.leaf_paths()) for a, b in zip(path, path[1:]))
PLACED = {"placed": """
    SELECT user_id, sku, date, quantity, roll_mean_28,
           CASE WHEN roll_mean_7 <= 25 THEN CASE WHEN dow <= 4 THEN 0 ELSE 1 END ELSE CASE WHEN lag_7 <= 30 THEN 2 ELSE 3 END END AS a,
           CASE WHEN dow <= 2 THEN 0 WHEN temp_avg <= 50 THEN 1 ELSE 2 END AS b
    FROM gold WHERE roll_mean_28 IS NOT NULL"""}


def placed(s):
    """Rows with the leaves of both trees."""
    rows = gold(s).filter("roll_mean_28 IS NOT NULL")
    return rows.select(*SERIES, "date", "quantity", "roll_mean_28", leaf_array(TREES, [F.col(f).cast("double") for f in FEATURES]).alias("leaves"))


@query("leaf_quantiles", """
    SELECT p.user_id, p.sku, p.date, q.q10, q.q50, q.q90 FROM placed p JOIN bands q USING (a, b)""", {**PLACED, "grid": f"""
    SELECT CAST(unnest({GRID}) AS DOUBLE) AS g""", "share_a": f"""
    SELECT a, g, avg(CASE WHEN quantity - roll_mean_28 <= g OR g = {GRID[-1]} THEN 1.0 ELSE 0.0 END) AS share FROM placed CROSS JOIN grid
    GROUP BY a, g""", "share_b": f"""
    SELECT b, g, avg(CASE WHEN quantity - roll_mean_28 <= g OR g = {GRID[-1]} THEN 1.0 ELSE 0.0 END) AS share FROM placed CROSS JOIN grid
    GROUP BY b, g""", "bands": """
    SELECT a, b, min(g) FILTER (s >= 0.15 - 1e-9) AS q10, min(g) FILTER (s >= 0.75 - 1e-9) AS q50, min(g) FILTER (s >= 1.35 - 1e-9) AS q90
    FROM (SELECT a, b, x.g, x.share + 0.5 * y.share AS s FROM share_a x JOIN share_b y ON x.g = y.g) GROUP BY a, b"""})
def _(s):
    """10 %, 50 % and 90 % points of what the rows of the same leaves are off their recent mean, all rows of the table."""
    rows = placed(s)
    found = leaf_errors(rows.select("leaves", (F.col("quantity") - F.col("roll_mean_28")).alias("error")), WEIGHTS, 4, grid=GRID)
    return rows.withColumn("_q", found.quantiles(F.col("leaves"))).select(
        *SERIES, "date", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(("q10", "q50", "q90"))])


@query("path_importance", """
    SELECT user_id, sku, factor, round(coalesce(c, 0.0) / CASE WHEN total > 0 THEN total ELSE 1.0 END, 6) AS importance
    FROM (SELECT user_id, sku, factor, c, sum(c) OVER (PARTITION BY user_id, sku) AS total
          FROM (SELECT DISTINCT user_id, sku FROM steps) CROSS JOIN (SELECT unnest(%s) AS factor)
          LEFT JOIN (SELECT user_id, sku, factor, greatest(sum(credit), 0.0) AS c FROM steps GROUP BY 1, 2, 3) USING (user_id, sku, factor))
    """ % FEATURES, {**PLACED, "targets": """
    SELECT *, quantity / greatest(roll_mean_28, 1.0) AS y, [0.75, 1.0, 1.125, 1.5][a + 1] AS v FROM placed""", "steps": f"""
    SELECT user_id, sku, factor, abs(r - before) - abs(r - after) AS credit FROM (
        SELECT user_id, sku, 0 AS t, a AS leaf, y AS r FROM targets UNION ALL SELECT user_id, sku, 1, b, y - v FROM targets)
    JOIN (VALUES {PATHS}) p(t, leaf, factor, before, after) USING (t, leaf)"""})
def _(s):
    """Share of each feature in the error that the paths of each series' rows take; the second tree explains what the first leaves."""
    y = F.col("quantity") / F.greatest("roll_mean_28", F.lit(1.0))
    first = TREES[0].leaf_paths()
    own = F.get(F.array(*[F.lit(TREES[0].value[p[-1]]) for p in first]), F.get("leaves", F.lit(0)))
    rows = placed(s).withColumn("residuals", F.array(y, y - own))
    shares = shares_of_credit(path_credits(rows, path_table(s.spark, TREES, [1.0, 1.0], FEATURES), SERIES), SERIES, FEATURES)
    return shares.withColumn("importance", F.round("importance", 6))
