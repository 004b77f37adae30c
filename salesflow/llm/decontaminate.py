"""Benchmark decontamination by winnowing.

Words are folded to lower case and hashed. From every run of ``WINDOW - K + 1`` consecutive K-grams of words the one
with the smallest hash is kept as a fingerprint. A window of ``WINDOW`` words is exactly one such run, so a window
that a text shares with an item leaves the same fingerprint in both: every shared span of that length is found. An
item shorter than a window is one window of its own length; for each such length (there are fewer than ``WINDOW``)
every gram of that length is a fingerprint.

The items' fingerprints set bits in a bitmap of fixed size (1 MB whatever the size of the benchmark), which is
sent to all tasks and lets them pass over nearly all training fingerprints before any shuffle; a full bitmap would pass
more and change nothing in the result. A fingerprint that passes is extended to the windows around it. These carry two
64-bit hashes and are joined with the items' windows; equal windows are hits.

Nulls and texts without words have no windows: n_words 0, not contaminated. Every row gives one row. Rows that repeat
an id with the same text get the same result; with another text they are judged apart. Items that repeat an id pool
their windows; an item without id marks words as hit but is not listed. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from salesflow.llm.textbytes import ALNUM, Words, batch_bytes, grams, lists, mix, signed, slices, within

K, WINDOW = 6, 13
BITS = 23  # the bitmap has 2 ** BITS bits
BUCKET = 32768  # bits in a row of Spark's bitmap aggregate
WINDOWS = "array<struct<n:int,h1:bigint,h2:bigint,at:int>>"
ENTRY = pa.struct([("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32())])


def winnowed(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and which of them are the smallest of a run of ``window - k + 1`` within one document."""
    found = grams(hashes, k)
    keep = np.zeros(len(found), bool)
    span = window - k + 1
    count = len(hashes) - window + 1
    if count > 0:
        inside = within(doc, window)
        least = found[:count].copy()
        for j in range(1, span):
            np.minimum(least, found[j:j + count], out=least)
        for j in range(span):
            keep[j:j + count] |= inside & (found[j:j + count] == least)
    return found, keep


def bit_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)


def windows_at(words: Words, at: np.ndarray, n: int) -> pa.StructArray:
    """Two hashes of each window of ``n`` words that starts at ``at``, and its place in its document."""
    h1, h2 = np.full(len(at), n, np.uint64), np.full(len(at), n + 7, np.uint64)
    for j in range(n):
        word = words.hashes[at + j]
        h1 = h1 * np.uint64(0x9FB21C651E98DF25) + word
        h2 = h2 * np.uint64(0xD1B54A32D192ED03) + mix(word)
    base = np.concatenate([[0], np.cumsum(words.counts)])
    place = at - base[words.doc[at]]
    return pa.StructArray.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(signed(mix(h1))), pa.array(signed(mix(h2))),
                                       pa.array(place.astype(np.int32))], fields=list(ENTRY))


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """All windows of the items with their fingerprint bits: item_id, n, h1, h2, bits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = batch_bytes(batch.column(1))
            for first, last in slices(bounds):
                words = Words(data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first], ALNUM)
                begins = np.cumsum(words.counts) - words.counts
                for n in range(1, WINDOW + 1):
                    if n < WINDOW:
                        at = begins[words.counts == n]
                        bits = [[int(b)] for b in bit_of(grams(words.hashes, n)[at], n)] if len(at) else []
                    else:
                        at = np.flatnonzero(within(words.doc, n))
                        found, keep = winnowed(words.hashes, words.doc)
                        marks = bit_of(found, 0)
                        bits = [[int(b) for b in marks[a:a + n - K + 1][keep[a:a + n - K + 1]]] for a in at]
                    if len(at):
                        window = windows_at(words, at, n)
                        ids = batch.column(0).take(pa.array(words.doc[at] + first))
                        yield pa.RecordBatch.from_arrays([ids, *window.flatten()[:3], pa.array(bits, pa.list_(pa.int64()))],
                                                         ["item_id", "n", "h1", "h2", "bits"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(items[key].alias("k"), items[text].cast("string").alias("t")).mapInArrow(
        each, f"item_id {kind}, n int, h1 bigint, h2 bigint, bits array<bigint>")


def bitmap_of(windows: DataFrame) -> tuple[bytes, list[int]]:
    """The bitmap (at most 2 ** BITS bits) and the lengths of short items (fewer than WINDOW)."""
    rows = windows.select(F.explode("bits").alias("b")).groupBy((F.col("b") / BUCKET).cast("long").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("b") % BUCKET).alias("part")).collect()
    marks = np.zeros(1 << BITS >> 3, np.uint8)
    for r in rows:
        marks[r.bucket * BUCKET // 8:(r.bucket + 1) * BUCKET // 8] = np.frombuffer(r.part, np.uint8)
    return marks.tobytes(), sorted(r.n for r in windows.filter(f"n < {WINDOW}").select("n").distinct().collect())


def doc_windows(docs: DataFrame, key: str, text: str, bitmap, lengths: list[int]) -> DataFrame:
    """One row per row of docs: key, a hash of the text, n_words, and the windows around fingerprints that pass."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bitmap.value, np.uint8)
        passes = lambda bits: (marks[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1
        for batch in batches:
            data, bounds = batch_bytes(batch.column(1))
            for first, last in slices(bounds):
                words = Words(data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first], ALNUM)
                parts = []
                found, keep = winnowed(words.hashes, words.doc)
                hits = np.flatnonzero(keep)
                hits = hits[passes(bit_of(found[hits], 0))]
                if len(hits):
                    inside = within(words.doc, WINDOW)
                    at = np.unique((hits[:, None] - np.arange(WINDOW - K + 1)).ravel())
                    at = at[(at >= 0) & (at < len(inside))]
                    parts.append((at[inside[at]], WINDOW))
                for n in lengths:
                    inside = np.flatnonzero(within(words.doc, n))
                    if len(inside):
                        parts.append((inside[passes(bit_of(grams(words.hashes, n)[inside], n))], n))
                at = np.concatenate([p for p, _ in parts] or [np.zeros(0, np.int64)]).astype(np.int64)
                flat = pa.concat_arrays([windows_at(words, p, n) for p, n in parts] or [pa.array([], ENTRY)])
                order = np.argsort(words.doc[at], kind="stable")
                counts = np.bincount(words.doc[at], minlength=last - first)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, last - first) for c in (batch.column(0), batch.column(2))), pa.array(words.counts),
                     pa.ListArray.from_arrays(offsets, flat.take(pa.array(order)))], ["k", "v", "n_words", "windows"])

    kind = docs.schema[key].dataType.simpleString()
    body = docs[text].cast("string")
    return docs.select(docs[key].alias("k"), body.alias("t"), F.xxhash64(body).alias("v")).mapInArrow(
        each, f"k {kind}, v bigint, n_words bigint, windows {WINDOWS}")


def covered(spans: str) -> F.Column:
    """Words in the union of [at, end) spans."""
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")), lambda a, s: F.struct(
        (a.n + F.greatest(s.end - F.greatest(s.at, a.upto), F.lit(0))).alias("n"), F.greatest(a.upto, s.end).alias("upto")), lambda a: a.n)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated, hits (the spans of words that items cover) and text_hash."""
    windows = item_windows(items, item_key, item_text)
    bitmap, lengths = bitmap_of(windows)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    each = doc_windows(docs, key, text, shared, lengths)
    known = windows.select("item_id", "n", "h1", "h2").distinct()
    hits = each.select("k", "v", F.explode("windows").alias("w")).select("k", "v", "w.*").join(known, ["n", "h1", "h2"]).groupBy("k", "v").agg(
        F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    a, b = each.select("k", "v", "n_words").alias("a"), hits.alias("b")
    out = a.join(b, F.expr("a.k <=> b.k AND a.v <=> b.v"), "left").select("a.*", "b.spans", "b.items")
    n_hit = F.coalesce(covered("spans"), F.lit(0).cast("long"))
    return out.select(
        F.col("k").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,end:int>>")).alias("hits"), F.col("v").alias("text_hash"))


# The same on DuckDB, window by window.
SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p + 1:p + n], ' ') AS g FROM (
    SELECT item_id, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS p FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT doc_id, item_id, p, n FROM dw JOIN iw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY ALL)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
