"""Connected components by contraction: every round hooks each node to its smallest neighbour and halves paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from salesflow.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of ``edges`` (a, b); comp is the smallest node that can be reached.

    Edges between nodes of one component vanish when both ends carry its name, so the graph shrinks in each
    round; it ends when no edge is left. Every round is written to the shared folder.
    """
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
    labels = materialize(labels, "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least("a", F.min("b")).alias("up"))
        hook = materialize(hook.join(hook.select(F.col("a").alias("up"), F.col("up").alias("top")), "up").select("a", "top"), "hooks")
        renamed = materialize(labels.join(hook.withColumnRenamed("a", "comp"), "comp", "left").select(
            "node", F.coalesce("top", "comp").alias("comp")), "labels")
        moved = edges.join(hook, "a").select(F.col("top").alias("x"), "b").join(hook.select(F.col("a").alias("b"), F.col("top").alias("y")), "b")
        left = materialize(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(edges, hook, labels)
        edges, labels = left, renamed
    discard(edges)
    return labels
