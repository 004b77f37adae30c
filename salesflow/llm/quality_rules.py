"""Quality rules: base counts of each text, and lines that too many documents of a host repeat.

Every line is normalised (its words in lower case, white space dropped) and hashed. For each host (the ``source`` of
a document) the documents that hold a line are counted; documents of one host with the same whole text count once, so
that a text copied often does not turn its own lines into boilerplate. Pages that only share most of their text, such as
those of one template, count each. A line is above the limit if it is in at least
``least`` documents and in more than ``share`` of the documents of its host. Lines above the limit are removed. A document
is depleted, and rejected, if fewer than ``MIN_WORDS`` words or less than ``left`` of its words remain.

Null and empty texts have no words: all counts 0, base_failed. A null host is a host of its own. Every row gives one
row, repeated rows alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from salesflow.llm.textbytes import FOLDED, PLAIN, Words, batch_bytes, grams, lists, mix, powers, signed, slices, span_hashes
from salesflow.session import materialize

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
LEAST, SHARE, LEFT = 20, 0.05, 0.3
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def line_table(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each \\n-split line."""
    cuts = np.flatnonzero(data == 10)
    filled = np.flatnonzero(bounds[1:] > bounds[:-1])
    starts = np.union1d(bounds[:-1][filled], cuts + 1)
    doc = np.searchsorted(bounds, starts, "right") - 1
    real = (starts < bounds[-1]) & ((starts == bounds[doc]) | (data[np.maximum(starts, 1) - 1] == 10))
    starts, doc = starts[real], doc[real]
    nexts = np.append(starts[1:], bounds[-1])
    ends = np.where(nexts < bounds[doc + 1], nexts - 1, bounds[doc + 1])
    ends = np.where((ends > starts) & (nexts == bounds[doc + 1]) & (data[np.maximum(ends, 1) - 1] == 10), ends - 1, ends)
    return starts, ends, doc


def facts_of(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts of each document, and hash and words of its lines that have a word."""
    n = len(bounds) - 1
    words = Words(data, bounds, PLAIN)
    per_doc = lambda marks: np.add.reduceat(np.append(marks, 0), bounds[:-1]) * (bounds[1:] > bounds[:-1]) if len(marks) else np.zeros(n, np.int64)
    chars = ((data & 0xC0) != 0x80) & (PLAIN[data] != 0)
    found = grams(words.hashes, REPEAT_WINDOW)
    inside = words.doc[:len(found)] == words.doc[len(words) - len(found):] if len(found) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    own = mix(found[at] + mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
    _, which, times = np.unique(own, return_inverse=True, return_counts=True)
    hit = np.zeros(len(words), bool)
    again = at[times[which] > 1] if len(at) else at
    for j in range(REPEAT_WINDOW):
        hit[again + j] = True

    starts, ends, doc = line_table(data, bounds)
    first = np.searchsorted(words.starts, starts)
    count = np.searchsorted(words.starts, ends) - first
    worded = count > 0
    starts, ends, doc, first, count = (x[worded] for x in (starts, ends, doc, first, count))
    raw = mix(span_hashes(data, starts, ends) + mix(doc.astype(np.uint64) + np.uint64(1)))
    _, earliest = np.unique(raw, return_index=True)
    fresh = np.zeros(len(raw), bool)
    fresh[earliest] = True
    folded = Words(data, bounds, FOLDED).hashes
    up, down = powers(len(folded) + 1)
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(mix(folded) * up[:len(folded)], out=sums[1:])  # each word counts with its place in the line
    line = mix((sums[first + count] - sums[first]) * down[first] + mix(count.astype(np.uint64)))
    bins = lambda where, weights=None: np.bincount(where, weights, minlength=n).astype(np.int64)
    return {"n_words": words.counts, "word_chars": per_doc(chars.astype(np.int64)), "n_symbols": per_doc(SYMBOLS[data].astype(np.int64)),
            "n_dup_lines": bins(doc[~fresh]), "n_repeat_words": bins(words.doc[hit]),
            "lines": line, "line_words": count, "line_counts": bins(doc)}


def facts(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """k, host, hash of the text, base counts, and lines array<struct<h,w>> of the lines with a word, for each row of docs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in batches:
            data, bounds = batch_bytes(batch.column(1))
            for first, last in slices(bounds):
                got = facts_of(data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first])
                rest = [c.slice(first, last - first) for c in (batch.column(0), batch.column(2), batch.column(3))]
                yield pa.RecordBatch.from_arrays(
                    [*rest, *(pa.array(got[x], pa.int64()) for x in names),
                     lists(signed(got["lines"]), got["line_counts"], pa.int64()), lists(got["line_words"], got["line_counts"], pa.int64())],
                    ["k", "host", "v", *names, "lines", "line_words"])

    kind = docs.schema[key].dataType.simpleString()
    body = docs[text].cast("string")
    return docs.select(docs[key].alias("k"), body.alias("t"), docs[host].cast("string").alias("host"), F.xxhash64(body).alias("v")).mapInArrow(
        each, f"k {kind}, host string, v bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
              "n_repeat_words bigint, lines array<bigint>, line_words array<bigint>")


def frequent_lines(found: DataFrame, least: int, share: float) -> DataFrame:
    """(host hash, line) above the limits, with the documents that hold it. Rows of one host and text count once; a null text is an empty one."""
    no_text = F.xxhash64(F.lit(None).cast("string"))
    found = found.select("g", "lines", F.when(F.col("v") == no_text, F.xxhash64(F.lit(""))).otherwise(F.col("v")).alias("v"))
    hosts = found.groupBy("g", "v").agg(F.lit(1).alias("one")).groupBy("g").agg(F.count("*").alias("docs"))
    held = found.select("g", "v", F.explode(F.array_distinct("lines")).alias("line"))
    # Two steps: rows of a frequent line are dealt by line and text first, so that no task gets all of them.
    counts = held.groupBy("g", "line", "v").agg(F.lit(1).alias("one")).groupBy("g", "line").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least).join(hosts, "g").filter(F.col("n") > share * F.col("docs")).select("g", "line", "n")


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least: int = LEAST,
                  share: float = SHARE, left: float = LEFT) -> DataFrame:
    """key, base counts, base_failed, kept, n_removed (words in removed lines), and removed (hashes of these lines)."""
    found = materialize(facts(docs, key, text, host).withColumn("g", F.xxhash64("host")), "facts")
    above = frequent_lines(found, least, share)
    held = found.select("k", "v", "g", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "k", "v", "g", F.col("l.lines").alias("line"), F.col("l.line_words").alias("w"))
    # Rows that repeat a document are counted once: the same line of each of them is in the set of (line, times) once.
    taken = held.join(above, ["g", "line"], "left_semi").groupBy("k", "v", "g", "line").agg(F.max("w").alias("w"))
    gone = taken.groupBy("k", "v", "g").agg(F.collect_set("line").alias("removed"))
    a, b = found.alias("a"), gone.alias("b")
    both = a.join(b, F.expr("a.k <=> b.k AND a.v <=> b.v AND a.g <=> b.g"), "left").select("a.*", "b.removed")
    n_removed = F.coalesce(F.aggregate(F.zip_with("lines", "line_words", lambda h, w: F.when(F.array_contains("removed", h), w).otherwise(0)),
                                       F.lit(0).cast("long"), lambda n, w: n + w), F.lit(0).cast("long"))
    n, remaining = F.col("n_words"), F.col("n_words") - n_removed
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n)
    depleted = (remaining < MIN_WORDS) | (remaining < left * n)
    return both.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       (~failed & ~((n_removed > 0) & depleted)).alias("kept"), n_removed.alias("n_removed"),
                       F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"), F.col("v").alias("text_hash"))


def without_lines(docs: DataFrame, text: str = "text", removed: str = "removed") -> DataFrame:
    """docs with the lines named in ``removed`` cut out of ``text``; the other lines stay as they are."""
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, gone = batch.column(names.index(text)), batch.column(names.index(removed)).to_pylist()
            texts = body.to_pylist()
            for i, hashes in enumerate(gone):
                if hashes and texts[i]:
                    lines = texts[i].split("\n")
                    data, bounds = batch_bytes(pa.array([texts[i]]))
                    got = iter(signed(facts_of(data, bounds)["lines"]).tolist())
                    worded = [any(c not in " \t\n\x0b\x0c\r" for c in line) for line in lines]
                    drop = set(hashes)
                    texts[i] = "\n".join(line for line, full in zip(lines, worded) if not (full and next(got) in drop))
            columns = [pa.array(texts, body.type) if c == text else batch.column(j) for j, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(each, docs.schema)
