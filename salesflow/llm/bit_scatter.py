"""Whitening of embeddings from an exact scatter matrix, computed on bit planes.

Every entry c becomes the whole number floor(64 * c); the fixed shift that the results name (1 000 000) changes neither
differences nor covariances and is added to none of the sums. A block of rows subtracts its smallest value per dimension and
writes each bit of what is left as a plane: one bit per row, packed into 64-bit words. The number of rows in which bit a of
dimension i and bit b of dimension j are both set is the population count of the AND of two planes; weighted by
2 ** (a + b) these counts add up to the exact cross product of the two dimensions. Blocks undo their shift as whole
numbers, tasks add up their blocks as whole numbers, and Spark sums the tasks limb by limb, so nothing overflows and the order
of rows and tasks changes nothing. The driver gets one number a pair of dimensions (the square of the dimension, whatever the rows),
centres them as whole numbers, n * sum(x * y) - sum(x) * sum(y), and only then divides and finds the eigenvectors.

Rows whose vector is null or holds a null or an entry that is not finite are dropped. Vectors may differ in length:
a short one counts as filled up with zeros, an empty one is all zeros. Rows that repeat are counted and returned each; a
null id stays null. A table without vectors, or with empty ones only, gives no rows. A direction without spread (eigenvalue
not above rounding) can't be scaled to one: its ``whitened`` is null and ``identity_error`` leaves it out. ``deviation``
is null where it does not fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SCALE = 64
COMPONENTS = 32
BLOCK = 1 << 14  # rows a block of bit planes
PAIR_WORDS = 1 << 22  # words of ANDed planes held at once
EXACT = 1 << 61
LIMB = 40  # bits of a limb; sums of 2 ** 23 tasks fit 64 bits


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * c) of an Arrow list column as rows of ``dims`` whole numbers, filled up with zeros.

    Entries beyond 64-bit range make the result an array of Python integers.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    small = not len(flat) or np.abs(flat).max() < EXACT
    out = np.zeros((len(lengths), dims), np.int64 if small else object)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = flat.astype(np.int64) if small else [int(v) for v in flat]
    return out


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of whole numbers from zero on: (bit, dimension, word), one bit per row."""
    rows, dims = values.shape
    bits = max(1, int(values.max()).bit_length()) if values.size else 1
    words = -(-rows // 64)
    out = np.zeros((bits, dims, words), np.uint64)
    for b in range(bits):
        marks = np.zeros((dims, words * 64), np.uint8)
        marks[:, :rows] = ((values >> b) & 1).T.astype(np.uint8)
        out[b] = np.packbits(marks, axis=1).view(np.uint64)
    return out


def weighted(counts: np.ndarray, shift: int) -> np.ndarray:
    """counts * 2 ** shift, as Python integers where 64 bits might not do."""
    limit = int(counts.max()) << shift if counts.size else 0
    return counts << shift if limit < EXACT >> 12 else counts.astype(object) * (1 << shift)


def scatter(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross products of rows of whole numbers, by population counts of ANDed bit planes."""
    dims = values.shape[1]
    sums, products = np.zeros(dims, object), np.zeros((dims, dims), object)
    for first in range(0, len(values), BLOCK):
        block = values[first:first + BLOCK]
        least = block.min(axis=0)
        planes = planes_of(block - least)
        bits, _, words = planes.shape
        own = np.zeros(dims, object)
        cross = np.zeros((dims, dims), object)
        step = max(1, PAIR_WORDS // max(1, dims * words))
        used = [b for b in range(bits) if planes[b].any()]
        for n_th, a in enumerate(used):
            own = own + weighted(np.bitwise_count(planes[a]).sum(axis=1, dtype=np.int64), a)
            for b in used[n_th:]:
                counts = np.concatenate([np.bitwise_count(planes[a, i:i + step, None, :] & planes[b, None, :, :]).sum(axis=2, dtype=np.int64)
                                         for i in range(0, dims, step)])
                both = weighted(counts, a + b)
                cross = cross + (both if a == b else both + both.T)
        low, n = least.astype(object), len(block)
        sums = sums + own + n * low
        products = products + cross + np.outer(low, own) + np.outer(own, low) + n * np.outer(low, low)
    return sums, products


def finite_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, e) of the rows whose vector is whole."""
    held = rows.select(rows[key].alias("k"), rows[vector].cast("array<double>").alias("e"))
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    return held.filter(F.col("e").isNotNull() & F.forall("e", good))


def limbs(entries: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """(i, j, whole number) as rows (i, j, limb, v) whose v add up without overflow."""
    rows = []
    for i, j, value in entries:
        limb = 0
        while value not in (0, -1):
            value, rest = divmod(value, 1 << LIMB)
            rows.append((i, j, limb, rest))
            limb += 1
        if value:
            rows.append((i, j, limb, value))
    columns = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "limb", "v"])


def fit_scatter(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross products of all vectors. Row -1, -1 of the exchange counts rows, row -1, j holds sums."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            s, p = scatter(whole(batch.column(0), dims))
            n, sums, products = n + batch.num_rows, sums + s, products + p
        if n:
            i, j = np.triu_indices(dims)
            yield limbs([(-1, -1, n), *((-1, d, v) for d, v in enumerate(sums)), *zip(i.tolist(), j.tolist(), products[i, j])])

    n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
    parts = vectors.select("e").mapInArrow(each, "i bigint, j bigint, limb bigint, v bigint").groupBy("i", "j", "limb").agg(F.sum("v").alias("v"))
    for r in parts.collect():  # a few rows a pair of dimensions
        value = r.v << LIMB * r.limb
        if r.j < 0:
            n += value
        elif r.i < 0:
            sums[r.j] += value
        else:
            products[r.i, r.j] += value
    products = products + np.triu(products, 1).T
    return n, sums, products


class Whitener:
    """Mean, components and eigenvalues; small enough to travel with the tasks (dims by components numbers)."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, components: int):
        centred = n * products - np.outer(sums, sums)  # whole numbers: n ** 2 times the covariance
        covariance = np.array([[v / (n * n) for v in row] for row in centred], np.float64)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1]
        self.n, self.sums = n, sums.tolist()
        self.values, self.vectors = values[order][:components], vectors[:, order][:, :components]
        trace = float(np.trace(covariance))
        self.spread = self.values > max(trace, 0.0) * len(values) * np.finfo(np.float64).eps
        self.explained = self.values / trace if trace > 0 else np.zeros(len(self.values))

    def differences(self, values: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        big = values.dtype == object or max(map(abs, self.sums), default=0) + self.n * int(np.abs(values).max(initial=0)) >= EXACT
        values = values.astype(object) if big else values
        return self.n * values - np.array(self.sums, object if big else np.int64)

    def whitened(self, differences: np.ndarray) -> np.ndarray:
        """Projections over the square root of the eigenvalue; nan for directions without spread."""
        scale = np.where(self.spread, np.sqrt(np.where(self.spread, self.values, 1.0)), np.nan)
        return (differences / self.n).astype(np.float64) @ self.vectors / scale


def deviations(differences: np.ndarray) -> list:
    """Sum of squares of each row as a whole number, None beyond 64 bits."""
    if differences.dtype != object and int(np.abs(differences).max(initial=0)) ** 2 * max(1, differences.shape[1]) < EXACT:
        return (differences * differences).sum(axis=1).tolist()
    out = [int(v) for v in (differences.astype(object) ** 2).sum(axis=1)]
    return [v if v < 1 << 63 else None for v in out]


def moments(vectors: DataFrame, dims: int, white: Whitener, centre: np.ndarray | None) -> list:
    """Sums over all rows of the whitened values, or with ``centre`` of the products of centred ones: (i, j, v)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(white.values)
        total = np.zeros((1 if centre is None else size, size))
        for batch in batches:
            z = white.whitened(white.differences(whole(batch.column(0), dims)))
            total += z.sum(axis=0) if centre is None else (z - centre).T @ (z - centre)
        i, j = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    return vectors.select("e").mapInArrow(each, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()


def identity_error(vectors: DataFrame, dims: int, white: Whitener) -> float:
    """Largest distance of the whitened rows' covariance from the identity, over directions with spread."""
    size = len(white.values)
    centre, second = np.zeros(size), np.zeros((size, size))
    for r in moments(vectors, dims, white, None):
        centre[r.j] = r.v / white.n
    for r in moments(vectors, dims, white, centre):
        second[r.i, r.j] = r.v / white.n
    off = np.abs(second - np.eye(size))[np.ix_(white.spread, white.spread)]
    return float(off.max()) if off.size else 0.0


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error: one row per whole vector and component."""
    kind = rows.schema[key].dataType.simpleString()
    vectors = finite_vectors(rows, key, vector)
    dims = vectors.agg(F.max(F.size("e")).alias("d")).first().d or 0
    schema = f"k {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not dims:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("k", key)
    white = Whitener(*fit_scatter(vectors, dims), components)
    error = identity_error(vectors, dims, white)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(white.values)
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                n = part.num_rows
                apart = white.differences(whole(part.column(1), dims))
                z = white.whitened(apart).ravel()
                row, tiled = pa.array(np.repeat(np.arange(n), size)), lambda per: np.tile(per, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), pa.array(tiled(np.arange(1, size + 1)), pa.int32()), pa.array(np.full(n * size, white.n)),
                     pa.array(deviations(apart), pa.int64()).take(row), pa.array(z, mask=np.isnan(z)), pa.array(tiled(white.explained)),
                     pa.array(np.full(n * size, error))],
                    ["k", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(each, schema).withColumnRenamed("k", key)
