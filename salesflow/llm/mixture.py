"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share all words; no target exceeds
CAP times its source, and the excess goes to the others by weight until none is above (one level of "water" for all).

Drawing: a source's documents are dealt by hash into blocks of about BLOCK_DOCS. A target of q whole sizes and a rest
takes every block q times and, in one more pass over the blocks in permuted order, blocks until the rest is used up; in
the block where that happens documents are taken in hash order, and the last of them only up to the words still wanted,
so a source's words meet its target to the word. Each source thus has an exact number of block slots. A binary tree
over the output shards splits these quotas: at each node the left half's share of every source is drawn from a
multivariate hypergeometric distribution, the right half gets the rest, so the shards' quotas add up exactly. A source's
slots, permuted pass by pass, then go to the shards in runs of their quotas: disjoint blocks. Within a shard, rows
are ordered by a hash (``place``), a local shuffle. All draws follow from SEED, so reruns agree. Quotas of a billion slots and
more are drawn source by source, counts that large by the normal law; they add up exactly all the same. Targets and quotas
have one row a source, and one task sees them all.

Null and empty texts have size 0; a source without words has target 0. Every row gives one row; rows that repeat an id
are dealt together. Other columns are ignored. Positions among a source's blocks are counted in two steps (BUCKETS
ranges of the permuted order, then within a range), so no task holds a source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from salesflow.session import materialize

WEIGHTS, CAP = (1, 2, 3), 3
BLOCK_DOCS, BUCKETS, SHARDS, SEED = 32, 256, 16, 7
LIBRARY = 10 ** 9  # NumPy draws from fewer than so many


def targets(sizes: DataFrame) -> DataFrame:
    """One row a source (g, source): source_size, docs, weight, target. There is one row a source from here on."""
    per = sizes.groupBy("g").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    every = Window.partitionBy()
    rising = Window.orderBy(CAP * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    ready = per.withColumn("weight", weight).withColumn("level", level)
    # In rising order of the cap, the first source whose cap is above the level sets it for all that follow.
    open_ = F.when(CAP * F.col("source_size") >= F.col("level") * F.col("weight"), F.col("level"))
    return ready.withColumn("water", F.first(open_, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(
        "g", "source", "source_size", "docs", "weight",
        F.least(F.col("water") * F.col("weight"), (CAP * F.col("source_size")).cast("double")).alias("target"))


def hypergeometric(draw: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` drawn ones are good; beyond the library's range by the normal law, cut to what can be."""
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    if max(good, bad) < LIBRARY:
        return int(draw.hypergeometric(good, bad, take))
    whole = good + bad
    mean = take * good / whole
    return min(max(round(mean + math.sqrt(mean * (bad / whole) * ((whole - take) / (whole - 1))) * draw.standard_normal()), low), high)


def hypergeometric_parts(draw: np.random.Generator, have: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` drawn ones are of each kind."""
    rest = int(have.sum())
    if rest < LIBRARY:
        return draw.multivariate_hypergeometric(have, take, method="marginals")
    parts = []
    for own in have.tolist():
        rest -= own
        parts.append(hypergeometric(draw, own, rest, take))
        take -= parts[-1]
    return np.array(parts, np.int64)


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(g, shard, quota) from (g, quota): exact parts of each source's quota for every shard.

    Level by level: a node holds a range of shards and a quota of each source, in one row a source.
    """
    nodes = quotas.select("g", F.col("quota").cast("long"), F.lit(0).alias("low"), F.lit(shards).alias("high"))

    def halve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g", ignore_index=True)
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        if high - low < 2:
            return rows
        middle = (low + high) // 2
        have = rows["quota"].to_numpy()
        draw = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = hypergeometric_parts(draw, have, int(have.sum()) * (middle - low) // (high - low))
        return pd.concat([rows.assign(quota=left, high=middle), rows.assign(quota=have - left, low=middle)])

    for _ in range(int(shards - 1).bit_length()):
        nodes = nodes.groupBy("low", "high").applyInPandas(halve, nodes.schema)
    return nodes.select("g", F.col("low").alias("shard"), "quota")


def positions(blocks: DataFrame, seed: int) -> DataFrame:
    """blocks (g, block, words) with ``at`` and ``before``: blocks and words ahead in the permuted order of the source."""
    key = F.xxhash64("g", "block", F.lit(seed))
    dealt = blocks.withColumn("r", key).withColumn("bucket", F.pmod(F.shiftrightunsigned("r", 40), F.lit(BUCKETS)).cast("int"))
    sums = dealt.groupBy("g", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    ahead = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("g", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"))
    inner = Window.partitionBy("g", "bucket").orderBy("r", "block").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(sums, ["g", "bucket"]).select(
        "g", "block", "words", (F.col("n0") + F.count("*").over(inner)).alias("at"),
        (F.col("w0") + F.coalesce(F.sum("words").over(inner), F.lit(0))).alias("before"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: key, size, source_size, target, taken, and draws, an array of (pass, shard, words, place)."""
    kind = docs.schema[key].dataType.simpleString()
    sizes = docs.select(docs[key].alias("k"), docs[source].cast("string").alias("source"), F.coalesce(F.regexp_count(
        docs[text].cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"))
    sizes = materialize(sizes.withColumn("g", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "sizes")
    aims = materialize(targets(sizes).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
        "rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")).withColumn(
        "blocks", F.ceil(F.col("docs") / BLOCK_DOCS)), "targets")
    dealt = sizes.join(aims, "g").select(
        "k", "g", "size", "source_size", "target", "passes", "rest", F.pmod(F.xxhash64("k", F.lit(seed)), F.col("blocks")).alias("block"))
    sums = dealt.groupBy("g", "block").agg(F.sum("size").alias("words"))
    placed = positions(sums, seed).join(aims.select("g", "passes", "rest"), "g")
    placed = materialize(placed.withColumn("part", F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), "words")), "blocks")

    drawn = placed.groupBy("g").agg(F.count("*").alias("n"), F.sum((F.col("part") > 0).cast("long")).alias("last"), F.first("passes").alias("passes"))
    quotas = drawn.withColumn("quota", F.col("n") * F.col("passes") + F.col("last"))
    parts = split(quotas.select("g", "quota"), shards, seed)
    ends = parts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("q")).join(quotas.select("g", "n"), "g").select("g", "n", F.aggregate(
        "q", F.array().cast("array<bigint>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x.quota)).alias("ends"))
    here = placed.join(ends, "g").select("g", "block", "part", "words", F.transform(F.sequence(F.lit(0), F.col("passes").cast("int")), lambda p: F.size(
        F.filter("ends", lambda e: e <= p * F.col("n") + F.col("at")))).alias("shards"))

    # Documents of a block that is taken in part go in hash order; such a block is one in each source.
    both = dealt.join(here, ["g", "block"])
    cut = (F.col("part") > 0) & (F.col("part") < F.col("words"))
    order = Window.partitionBy("g", "block").orderBy(F.xxhash64("k", F.lit(seed + 1)), "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    partly = both.filter(cut).withColumn("last", F.least("size", F.greatest(F.lit(0), F.col("part") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    out = partly.unionByName(both.filter(~cut).withColumn("last", F.when(F.col("part") > 0, F.col("size")).otherwise(0)))
    place = lambda p: F.xxhash64("k", p, F.lit(seed + 2))
    draws = F.filter(F.transform("shards", lambda s, p: F.struct(
        p.alias("pass"), s.alias("shard"), F.when(p < F.col("passes"), F.col("size")).otherwise(F.col("last")).alias("words"), place(p).alias("place"))), lambda d: d.words > 0)
    return out.select(F.col("k").cast(kind).alias(key), "size", "source_size", "target",
                      (F.col("passes") * F.col("size") + F.col("last")).cast("long").alias("taken"), draws.alias("draws"))
