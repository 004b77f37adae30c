"""Newest row per key and first n per key, without one task holding a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from salesflow.session import materialize


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key, missing order values lowest.

    A maximum over a struct is combined before the shuffle, so a key holding a large share of the
    rows sends one row per task. Columns behind ``order`` break what ties remain.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_newest"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_newest.{c}").alias(c) for c in df.columns])


GROUP_LIMIT = 1000  # Spark cuts groups ahead of the shuffle up to this rank
PARTS = 32


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, position: str | None = None) -> DataFrame:
    """First ``n`` rows per key.

    Up to GROUP_LIMIT the rank filter lets Spark cut groups before the shuffle. Beyond it the first rows of each of
    PARTS parts of a group are found first, so that the last step reads at most PARTS * n rows of a key.
    """
    name = position or "_position"
    if n > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
        heads = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_head", F.row_number().over(heads)).filter(F.col("_head") <= n).drop("_part", "_head")
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return ranked if position else ranked.drop(name)


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of an ordered table."""
    return df.orderBy(*order).offset(offset).limit(limit)


def after(order: list[tuple[str, bool]], last: list) -> Column:
    """Rows behind the row with the order keys ``last``; ``order`` is (column, whether descending). NULL is the smallest value."""
    behind = F.lit(False)
    for (column, descending), value in reversed(list(zip(order, last))):
        c = F.col(column)
        equal = c.isNull() if value is None else c == F.lit(value)
        if descending:
            beyond = F.lit(False) if value is None else (c < F.lit(value)) | c.isNull()
        else:
            beyond = c.isNotNull() if value is None else c > F.lit(value)
        behind = beyond | (equal & behind)
    return F.coalesce(behind, F.lit(False))


def seek(df: DataFrame, order: list[tuple[str, bool]], last: list | None = None, limit: int = 50) -> DataFrame:
    """The page behind the row whose order keys are ``last``, the first page without.

    ``order`` must tell rows apart. The bound on the first key reaches the scan and the rest is a top-k, so a page costs the
    same wherever it is, and rows that are added meanwhile neither repeat nor hide others.
    """
    if last is not None:
        (first, descending), value = order[0], last[0]
        if value is not None:  # a filter that files can be skipped by
            df = df.filter((F.col(first) <= F.lit(value)) | F.col(first).isNull() if descending else F.col(first) >= F.lit(value))
        df = df.filter(after(order, last))
    keys = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c, descending in order]
    return df.orderBy(*keys).limit(limit)


def cursor(page_rows: DataFrame, order: list[tuple[str, bool]]) -> list | None:
    """Order keys of the last row of a page, for the next one; None behind the last page."""
    rows = page_rows.select(*[c for c, _ in order]).tail(1)
    return list(rows[0]) if rows else None


def pages(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Every row of an ordered table with its ``page``, counted from 0, for a reader that fetches them all.

    Rows are dealt into ranges of the order and numbered within each; the ranges' row counts give the first number of each.
    ``order`` must tell rows apart.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_range").orderBy(*order)
    at = F.col("_first") + F.row_number().over(within) - 1
    return ranged.join(firsts, "_range").select(*df.columns, F.floor(at / size).alias("page"))


def page_per_key(df: DataFrame, keys: list[str], order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """The same page for every key at once."""
    kept = top_n(df, keys, order, offset + limit, position="position")
    return kept.filter(F.col("position") > offset)


def missing_keys(requested: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(present.select(*keys).distinct(), keys, "left_anti")


def flag_exists(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Boolean column: does the key occur in ``other``."""
    marks = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(marks, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]
