"""Removal of repeated byte passages with a logarithmic family of sparse suffix arrays.

Suffixes are kept at anchors only. Every MATCH bytes hold MATCH - K + 1 K-grams, and the leftmost of those with the
smallest hash is the window's anchor: equal windows have their anchors at equal places, so a repeated window
starts from an anchor whose K-gram occurs twice. A batch of documents (in ascending order of ids) gets an array of
its anchors' suffixes by a hash of their first K bytes, with the first document of each. The array is scanned
against the levels of the index and against itself for K-grams that occur before; then it becomes a level, and levels
of equal size merge, each into one of twice the size, so n batches leave at most log2(n) + 1 levels and a suffix
is rewritten log2(n) times. ``Index`` can be given further batches.

A bitmap of fixed size remembers which K-grams were found twice, and only their anchors go on to the exact part (a
full bitmap passes more and changes nothing). An anchor owns the windows that have it as theirs, a
contiguous range. Anchors whose owned bytes are equal form a class: all but the first repeat it as a whole. Of first ones
that share a K-gram but differ in their bytes, windows are compared one by one by hash, after parts of 83 bytes that
every window of a range contains have shown that the range can match. Whatever repeats an earlier window is removed.

Null and empty texts have nothing to remove. The order is (id, start); rows that repeat an id are not earlier than
one another, so copies under one id keep each other's bytes. A row without id is in the result, untouched: it has no
place in the order. Other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from salesflow.llm.textbytes import batch_bytes, mix, signed, slices, span_hashes
from salesflow.session import discard, materialize

MATCH, K = 100, 32
SPAN = MATCH - K + 1  # K-grams in a window
PART = 17  # windows whose anchor is at most so many places apart share MATCH - PART bytes
BITS, BUCKET = 27, 32768  # of the bitmap; bits in a row of Spark's bitmap aggregate
PLACE = 24  # bits of a place in the key that finds the leftmost smallest gram; longer documents go in pieces
BATCHES = 4
FACTOR = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each K bytes (K a power of two), by doubling."""
    h, factor, n = data.astype(np.uint64) + np.uint64(1), FACTOR, 1
    while n < K:
        h = h[:-n] * np.uint64(factor) + h[n:]
        factor, n = factor * factor & (1 << 64) - 1, 2 * n
    return mix(h)


def anchors_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: document, place, first and last window owned (places in data), and K-gram hash."""
    count = len(data) - MATCH + 1
    if count < 1:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    grams = gram_hashes(data)
    key = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(grams), dtype=np.uint64)
    least, n = key, 1
    while 2 * n <= SPAN:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    least = np.minimum(least[:count], least[SPAN - n:SPAN - n + count])
    anchor = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    inside = np.zeros(count + 1, np.int64)
    lengths = np.diff(bounds)
    long = lengths >= MATCH
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - MATCH + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    doc = np.searchsorted(bounds, starts, "right") - 1
    own = anchor[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], own[first], starts[first], starts[last], grams[own[first]]


def pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes, bounds, index of the first document and place of the first byte in it, so that all windows occur once."""
    for first, last in slices(bounds):
        low, high = int(bounds[first]), int(bounds[last])
        size = 1 << PLACE - 1
        if high - low <= size:
            yield data[low:high], bounds[first:last + 1] - low, first, 0
        else:
            for at in range(low, max(low + 1, high - MATCH + 1), size - MATCH + 1):
                end = min(at + size, high)
                yield data[at:end], np.array([0, end - at]), first, at - low


def bit_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BITS)).astype(np.int64)


def anchor_rows(docs: DataFrame, marks=None) -> DataFrame:
    """docs (k, t) to anchors (k, g: K-gram hash); with ``marks`` only marked ones, with their class c, the first window
    owned (low), the anchor's distance from it (off) and the last window's (len)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if marks is None else np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            data, bounds = batch_bytes(batch.column(1))
            for body, edges, first, shift in pieces(data, bounds):
                doc, at, low, high, grams = anchors_of(body, edges)
                columns = []
                if known is not None:
                    bits = bit_of(grams)
                    pick = (known[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1
                    doc, at, low, high, grams = (x[pick] for x in (doc, at, low, high, grams))
                    own = mix(span_hashes(body, low, high + MATCH) + (at - low).astype(np.uint64))
                    columns = [pa.array(signed(own)), pa.array(low - edges[doc] + shift, pa.int64()),
                               *(pa.array(x, pa.int32()) for x in (at - low, high - low))]
                if len(doc):
                    keys = batch.column(0).take(pa.array(doc + first))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(signed(grams)), *columns], ["k", "g", "c", "low", "off", "len"][:2 + len(columns)])

    kind = docs.schema["k"].dataType.simpleString()
    return docs.mapInArrow(each, f"k {kind}, g bigint" + (", c bigint, low bigint, off int, len int" if marks is not None else ""))


def tidy(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to, so that Spark removes the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Index:
    """Levels of suffix arrays (g, k): a K-gram hash and the first document of the level that has it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, []  # (batches in the level, table)
        self.marks = np.zeros(1 << BITS >> 3, np.uint8)

    def add(self, docs: DataFrame) -> None:
        """Scan a new batch (k, t) against itself and the levels, mark K-grams that occur twice, and take it in."""
        new = materialize(anchor_rows(docs).groupBy("g").agg(F.min("k").alias("k"), F.count("*").alias("n")), "suffixes")
        twice = new.filter("n > 1").select("g")
        for _, level in self.levels:
            twice = twice.union(new.join(level, "g", "left_semi").select("g"))
        bit = F.shiftrightunsigned("g", 64 - BITS)
        rows = twice.groupBy(F.floor(bit / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(bit % BUCKET).alias("part")).collect()
        for r in rows:  # at most 2 ** BITS bits in all
            self.marks[r.bucket * BUCKET // 8:(r.bucket + 1) * BUCKET // 8] |= np.frombuffer(r.part, np.uint8)
        self.levels.append((1, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (_, b) = self.levels.pop(), self.levels.pop()
            both = a.select("g", "k").union(b.select("g", "k"))
            self.levels.append((2 * n, materialize(both.groupBy("g").agg(F.min("k").alias("k")), "suffixes")))
            discard(a, b)
        tidy(self.spark)

    def close(self) -> None:
        discard(*(table for _, table in self.levels))
        self.levels.clear()


def batches_of(docs: DataFrame, count: int) -> list[DataFrame]:
    """docs in ``count`` ranges of ids with about equal bytes; together they are all rows with an id."""
    sizes = docs.filter("k IS NOT NULL").select("k", F.octet_length("t").alias("b"))
    cuts = sizes.agg(F.percentile_approx("k", F.array(*[F.lit(i / count) for i in range(1, count)]), F.lit(1000)).alias("q")).first().q if count > 1 else []
    edges = sorted(set(cuts or []))
    low = [None, *edges]
    high = [*edges, None]
    out = []
    for a, b in zip(low, high):
        part = docs.filter("k IS NOT NULL")
        part = part if a is None else part.filter(F.col("k") > F.lit(a))
        out.append(part if b is None else part.filter(F.col("k") <= F.lit(b)))
    return out


def owned_windows(docs: DataFrame, wanted: DataFrame, parts: bool) -> DataFrame:
    """The windows of ranges (k, low, off, len) of anchors: (k, low, off, w), one row a window with its hash w.

    With ``parts`` one row for each part of a range instead: windows whose distance from the anchor is the same
    but for less than PART, with the hash of the bytes that all windows of such a part contain.
    """
    lists = wanted.groupBy("k").agg(F.collect_set(F.struct("low", "off", "len")).alias("a"))
    joined = docs.join(lists, "k").select("k", "t", "a")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, _ = batch_bytes(batch.column(1).slice(i, 1))
                rows = batch.column(2).slice(i, 1).flatten()
                low, off, len_ = (rows.field(n).to_numpy().astype(np.int64) for n in ("low", "off", "len"))
                fits = low + len_ + MATCH <= len(data)
                low, off, len_ = low[fits], off[fits], len_[fits]
                if not len(low):
                    continue
                if parts:
                    at, begin = low + off, np.arange(0, SPAN, PART)
                    a = np.maximum(low[:, None], at[:, None] - begin - PART + 1)
                    b = np.minimum((low + len_)[:, None], at[:, None] - begin)
                    row, part = np.nonzero(a <= b)
                    start, size = at[row] - begin[part], MATCH - PART + 1  # the last window of a whole part starts there
                    first, off, len_, seed = a[row, part], (at[row] - a[row, part]), (b - a)[row, part], begin[part]
                else:
                    row = np.repeat(np.arange(len(low)), len_ + 1)
                    first = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(len_ + 1) - len_ - 1, len_ + 1)
                    start, size, seed = first, MATCH, np.zeros(len(row), np.int64)
                    off, len_ = off[row] + low[row] - first, np.zeros(len(row), np.int64)
                order = np.argsort(start, kind="stable")
                hashes = np.zeros(len(start), np.uint64)
                hashes[order] = span_hashes(data, start[order], start[order] + size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(len(start), i))), pa.array(first), pa.array(off, pa.int32()), pa.array(len_, pa.int32()),
                     pa.array(signed(mix(hashes + seed.astype(np.uint64))))], ["k", "low", "off", "len", "w"])

    kind = docs.schema["k"].dataType.simpleString()
    return joined.mapInArrow(each, f"k {kind}, low bigint, off int, len int, w bigint")


def repeated_ranges(docs: DataFrame, marks) -> DataFrame:
    """(k, ranges) of bytes that repeat an earlier window, from docs (k, t); ranges may overlap."""
    spark = docs.sparkSession
    # A place in the order as one number: the id, and the window's start in the lowest 40 bits.
    place = F.expr("cast(k AS decimal(19, 0)) * 1099511627776BD + low")
    found = materialize(anchor_rows(docs.filter("k IS NOT NULL"), marks), "anchors")
    classes = materialize(found.groupBy("g", "c").agg(F.min(place).alias("first"), F.count("*").alias("n")), "classes")
    several = classes.groupBy("g").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("g", F.lit(True).alias("several"))
    known = classes.join(several, "g", "left").filter("n > 1 OR several")
    judged = materialize(found.join(known, ["g", "c"]).select("k", "low", "off", "len", (place > F.col("first")).alias("again"), "several").filter(
        "again OR several"), "judged")
    discard(found, classes)
    tidy(spark)
    whole = judged.filter("again").select("k", F.col("low").alias("start"), (F.col("low") + F.col("len") + MATCH).alias("end"))
    parts = materialize(owned_windows(docs, judged.filter("NOT again AND several"), True), "parts")
    likely = parts.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    windows = materialize(owned_windows(docs, parts.join(likely, "w", "left_semi"), False).select("k", "low", "w"), "windows")
    discard(parts)
    tidy(spark)
    firsts = windows.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("w", "first")
    single = windows.join(firsts, "w").filter(place > F.col("first")).select("k", F.col("low").alias("start"), (F.col("low") + MATCH).alias("end"))
    ranges = materialize(whole.union(single).groupBy("k").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "ranges")
    discard(judged, windows)
    tidy(spark)
    return ranges


def kept_bytes(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """k, n_bytes, n_removed, n_spans, kept_sha256, and spans (the maximal removed runs) for each row of docs (k, t)."""
    import hashlib

    joined = docs.join(ranges, "k", "left").select("k", "t", "ranges")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = batch_bytes(batch.column(1))
            sizes, removed, counts, shas, spans = [], [], [], [], []
            for i in range(batch.num_rows):
                body = data[bounds[i]:bounds[i + 1]]
                rows = batch.column(2).slice(i, 1).flatten()
                starts, ends = (np.sort(rows.field(n).to_numpy()) if len(rows) else np.zeros(0, np.int64) for n in ("start", "end"))
                fresh = np.append(True, starts[1:] > ends[:-1]) if len(starts) else np.zeros(0, bool)
                starts, ends = starts[fresh], ends[np.append(fresh[1:], True)] if len(ends) else ends
                keep, at = hashlib.sha256(), 0
                for s, e in zip(starts, ends):
                    keep.update(body[at:s].tobytes())
                    at = e
                keep.update(body[at:].tobytes())
                sizes.append(len(body))
                removed.append(int((ends - starts).sum()))
                counts.append(len(starts))
                shas.append(keep.hexdigest())
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(shas, pa.string()), pa.array(spans, pa.list_(span))],
                ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema["k"].dataType.simpleString()
    return joined.mapInArrow(each, f"k {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and spans, one row per row of docs."""
    spark = docs.sparkSession
    held = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    index = Index(spark)
    for part in batches_of(held, batches):
        index.add(part)
    index.close()
    ranges = repeated_ranges(held, spark.sparkContext.broadcast(index.marks.tobytes()))
    return kept_bytes(held, ranges).withColumnRenamed("k", key)
