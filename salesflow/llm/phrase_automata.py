"""Removal of repeated phrases: recurring passages are confirmed, compiled into Aho-Corasick automata and located everywhere.

1. Anchors. Every WINDOW words hold WINDOW - K + 1 runs of K words; the leftmost one with the smallest hash is the window's
   anchor, so equal windows have equal anchors. An anchor owns the consecutive windows that have it. Only anchors whose run
   starts in more than one document (smallest and largest id, combined before the shuffle) can own a recurring window.
2. Confirmation. The windows of such anchors are counted by two hashes (108 bits); one that starts under more than one id is
   confirmed, with the smallest of them. Its words are read from that document, consecutive windows as one passage.
3. Automata. The windows of confirmed passages are dealt into shards by their anchor and compiled with pyahocorasick over
   numbers of exact words, so that a hash never decides what is removed. Each document's stretches around recurring anchors
   go, as text, to the shards of their anchors and stream through. A shard of too many phrases is dealt into parts that each
   see its stretches; a shard of too many stretches is copied to several tasks that share them. What decides this has been
   counted before. A task holds one automaton and one batch of stretches.
4. A located phrase whose first document has a smaller id is removed.

All steps deal by hashes; no list is longer than a document. Nulls and texts without words have nothing to remove
(0 words, hash of an empty text). Copies under one id do not remove each other's words, within a row or in rows that repeat
an id. A row without id is returned whole and removes nothing: it has no place in the order. Rows that repeat give a row
each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from salesflow.llm.steps import tidy
from salesflow.llm.textbytes import PLAIN, Words, batch_bytes, grams, mix, powers, signed, slices, within
from salesflow.session import materialize

WINDOW, K = 13, 6
SPAN = WINDOW - K + 1
PHRASES = 200_000  # in one automaton, at most: about 100 MB
VARIANTS = 16  # pieces with one core before they are entered window by window
STRETCHES = 200_000  # anchors whose stretches one task gets, about
SLOT = 20  # bits of an anchor's hash that a window's second hash ends in
SHARE = 12  # bits for the part and for the task in the number of a task's group
APART = b"\xff"  # no UTF-8 text holds this byte: a word that is in no phrase


def anchors_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners of all windows: anchor's place, first and last window owned (places in words), and the hash of its run."""
    found = grams(words.hashes, K)
    count = len(words) - WINDOW + 1
    if count < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    best, own = found[:count].copy(), np.arange(count)
    for j in range(1, SPAN):
        less = found[j:j + count] < best
        best[less] = found[j:j + count][less]
        own[less] = np.flatnonzero(less) + j
    starts = np.flatnonzero(within(words.doc, WINDOW))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    own, doc = own[starts], words.doc[starts]
    fresh = np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    return own[first], starts[first], starts[last], found[own[first]]


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each hashes[s:e]; all ranges are equally long."""
    up, down = powers(len(hashes) + 1)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)) * up[:len(hashes)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * down[starts]))
    return out[0], out[1]


class Owned:
    """Anchors of some documents with what they own, as places in their words."""

    def __init__(self, words: Words):
        self.words = words
        self.at, self.low, self.high, self.gram = anchors_of(words)
        self.doc = words.doc[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.base = np.cumsum(words.counts) - words.counts

    def pick(self, keep: np.ndarray) -> None:
        self.at, self.low, self.high, self.gram, self.doc = (x[keep] for x in (self.at, self.low, self.high, self.gram, self.doc))

    def pick_grams(self, wanted: list[np.ndarray]) -> None:
        """Keep the anchors whose run is among those wanted of its document."""
        counts = np.array([len(w) for w in wanted])
        keys = [(d.astype(np.uint64) << np.uint64(40)) ^ (g >> np.uint64(24)) for d, g in (
            (np.repeat(np.arange(len(wanted)), counts), np.concatenate(wanted).view(np.uint64)), (self.doc, self.gram))]
        self.pick(np.isin(keys[1], keys[0]))

    def slots(self) -> np.ndarray:
        return (self.gram >> np.uint64(64 - SLOT)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the anchor, start, and two hashes of each owned window; the second one ends in the anchor's slot."""
        sizes = self.high - self.low + 1
        which = np.repeat(np.arange(len(self.at)), sizes)
        starts = self.low[which] + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        h1, h2 = range_hashes(self.words.hashes, starts, starts + WINDOW)
        return which, starts, signed(h1), signed((h2 >> np.uint64(SLOT) << np.uint64(SLOT)) | self.slots()[which].astype(np.uint64))

    def bodies(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Bytes from word ``starts`` up to word ``ends``."""
        raw = data.tobytes()
        return pa.array([raw[a:b] for a, b in zip(self.words.starts[starts].tolist(), self.words.ends[ends - 1].tolist())], pa.binary())


def runs_of(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run, from marks of where one begins."""
    first = np.flatnonzero(fresh)
    return first, np.append(first[1:], len(fresh)) - 1


def parts_of(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    """Ranges of a batch's rows with their bytes and words."""
    column = batch.column(text)
    data, bounds = batch_bytes(column.cast(pa.large_binary()).cast(pa.large_string()) if pa.types.is_binary(column.type) else column)
    for first, last in slices(bounds):
        body = data[bounds[first]:bounds[last]]
        yield first, last, body, Words(body, bounds[first:last + 1] - bounds[first], PLAIN)


def arrays(column: pa.Array, first: int, last: int) -> list[np.ndarray]:
    """Lists of whole numbers of some rows; null is empty."""
    return [np.array(v or [], np.int64) for v in column.slice(first, last - first).to_pylist()]


def comparable(ids: list) -> np.ndarray:
    return np.array(ids, np.int64 if all(isinstance(i, int) for i in ids) else object)


def marks(docs: DataFrame, kind: str) -> DataFrame:
    """Runs at the anchors of docs (k, t): g, k."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, _, words in parts_of(batch, 1):
                own = Owned(words)
                if len(own.at):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(own.gram)), batch.column(0).take(pa.array(own.doc + first))], ["g", "k"])

    return docs.select("k", "t").mapInArrow(each, f"g bigint, k {kind}")


HELD = "v bigint, n_words bigint, kept_sha256 string, t binary, grams array<bigint>"


def held_texts(docs: DataFrame, grams: DataFrame, kind: str) -> DataFrame:
    """k, v, n_words of all docs; the result's hash where no run recurs, else the text and the recurring runs of its id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, texts = [], [], []
            for text, some in zip(batch.column(2).cast(pa.large_binary()), batch.column(3).is_valid().to_pylist()):
                body = text.as_py() or b""
                words = body.split()
                counts.append(len(words))
                shas.append(None if some else hashlib.sha256(b" ".join(words)).hexdigest())
                texts.append(body if some else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                                              pa.array(texts, pa.binary()), batch.column(3)], ["k", "v", "n_words", "kept_sha256", "t", "grams"])

    joined = docs.join(grams, "k", "left").select("k", "v", "t", "grams")
    return joined.mapInArrow(each, f"k {kind}, {HELD}")


def window_rows(texts: DataFrame, kind: str) -> DataFrame:
    """Windows around recurring runs: h1, h2, k."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, words in parts_of(batch, 1):
                own = Owned(words)
                own.pick_grams(arrays(batch.column(2), first, last))
                which, _, h1, h2 = own.windows()
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(0).take(pa.array(own.doc[which] + first))], ["h1", "h2", "k"])

    return texts.select("k", "t", "grams").mapInArrow(each, f"h1 bigint, h2 bigint, k {kind}")


def passages_of(texts: DataFrame, confirmed: DataFrame, kind: str) -> DataFrame:
    """The words of confirmed windows (h1, h2, first), read from their first document: slot, first, body. Consecutive ones of a slot are one row."""
    lists = confirmed.groupBy(F.col("first").alias("k")).agg(F.collect_list("h1").alias("h1"), F.collect_list("h2").alias("h2"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, words in parts_of(batch, 1):
                own = Owned(words)
                own.pick_grams(arrays(batch.column(2), first, last))
                which, starts, h1, h2 = own.windows()
                wanted = [arrays(batch.column(c), first, last) for c in (3, 4)]
                row = np.repeat(np.arange(last - first), [len(w) for w in wanted[0]])
                known = set(zip(row.tolist(), *(np.concatenate(w).tolist() for w in wanted)))
                keep = np.array([key in known for key in zip(own.doc[which].tolist(), h1.tolist(), h2.tolist())], bool)
                which, starts = which[keep], starts[keep]
                if not len(starts):
                    continue
                slot = own.slots()[which]
                fresh = np.append(True, (slot[1:] != slot[:-1]) | (starts[1:] != starts[:-1] + 1))
                a, b = runs_of(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(slot[a]), batch.column(0).take(pa.array(own.doc[which[a]] + first)),
                                                  own.bodies(data, starts[a], starts[b] + WINDOW)], ["slot", "first", "body"])

    return texts.join(lists, "k").select("k", "t", "grams", "h1", "h2").mapInArrow(each, f"slot bigint, first {kind}, body binary")


def stretches(texts: DataFrame, shards: int, kind: str) -> DataFrame:
    """What recurring anchors own, joined while the shard stays the same: shard, k, v, at (word), body."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, words in parts_of(batch, 2):
                own = Owned(words)
                own.pick_grams(arrays(batch.column(3), first, last))
                if not len(own.at):
                    continue
                shard = own.slots() % shards
                fresh = np.append(True, (shard[1:] != shard[:-1]) | (own.low[1:] != own.high[:-1] + 1) | (own.doc[1:] != own.doc[:-1]))
                a, b = runs_of(fresh)
                starts, doc = own.low[a], own.doc[a]
                row = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[a]), batch.column(0).take(row), batch.column(1).take(row), pa.array(starts - own.base[doc]),
                     own.bodies(data, starts, own.high[b] + WINDOW)], ["shard", "k", "v", "at", "body"])

    return texts.select("k", "v", "t", "grams").mapInArrow(each, f"shard bigint, k {kind}, v bigint, at bigint, body binary")


def coded(words: Iterable[bytes], numbers: dict[bytes, int], count: int) -> np.ndarray:
    """Numbers of words, -1 for words without one."""
    return np.fromiter(map(numbers.get, words, repeat(-1)), np.int64, count)


class Automaton:
    """The phrases of one task: passages whose windows have the same first document, over numbers of exact words.

    A passage is cut into pieces of at most SPAN windows. All windows of a piece share its core, the words that begin at its last
    window and end with its first one. The machine finds cores; where one is found, the words around it are compared with the
    piece's, and a run of at least WINDOW equal words consists of windows of the piece. Pieces that share a core with many others
    are entered window by window, so that no occurrence is compared with many.

    A word's number is two characters, the first from one range and the second from another, so that no state has many successors
    (pyahocorasick looks through them one by one) and no match begins in the middle of a word.
    """

    def __init__(self, passages: list[tuple[bytes, object]]):
        import ahocorasick

        split = [body.split() for body, _ in passages]
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        self.base = max(2, math.isqrt(len(self.numbers)) + 1)
        self.flat = coded(chain.from_iterable(split), self.numbers, sum(map(len, split)))
        ids: dict[object, int] = {}
        starts, sizes, owners, at = [], [], [], 0
        for words, (_, first) in zip(split, passages):
            owner = ids.setdefault(first, len(ids))
            for low in range(0, len(words) - WINDOW + 1, SPAN):
                starts.append(at + low)
                sizes.append(min(SPAN, len(words) - WINDOW + 1 - low))
                owners.append(owner)
            at += len(words)
        text = self.text(self.flat)
        cores: dict[str, list[int]] = {}
        for i, (start, size) in enumerate(zip(starts, sizes)):
            core = text[2 * (start + size - 1):2 * (start + WINDOW)]
            if size > 1 or core not in cores:
                cores.setdefault(core, []).append(i)
        for core in [c for c, pieces in cores.items() if len(pieces) > VARIANTS and len(c) < 2 * WINDOW]:
            for i in cores.pop(core):
                for start in range(starts[i], starts[i] + sizes[i]):
                    window = text[2 * start:2 * (start + WINDOW)]
                    if window in cores:  # a window has one first document, so one piece is enough
                        continue
                    cores[window] = [len(starts)]
                    starts.append(start)
                    sizes.append(1)
                    owners.append(owners[i])
        self.starts, self.sizes, self.owners, self.firsts = np.array(starts), np.array(sizes), np.array(owners), comparable(list(ids))
        self.pieces = np.array([i for pieces in cores.values() for i in pieces], np.int64)
        self.counts = np.array([len(pieces) for pieces in cores.values()], np.int64)
        self.heads = np.cumsum(self.counts) - self.counts
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, core in enumerate(cores):
            self.machine.add_word(core, i)
        if cores:
            self.machine.make_automaton()

    def text(self, numbers: np.ndarray) -> str:
        """Two characters a word; a word without a number has a pair that is in no phrase."""
        pairs = np.empty((len(numbers), 2), np.uint32)
        pairs[:, 0] = np.where(numbers < 0, 1, 2 + numbers // self.base)
        pairs[:, 1] = self.base + 16 + numbers % self.base
        return pairs.tobytes().decode("utf-32-le")

    def located(self, bodies: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of words under phrases with a smaller first id: index of the body, first word, word after the last."""
        none = np.zeros(0, np.int64)
        if not len(self.pieces) or not bodies:
            return none, none, none
        split = [body.split() for body in bodies]
        sizes = np.array([len(words) + 1 for words in split])
        numbers = coded(chain.from_iterable((*words, APART) for words in split), self.numbers, int(sizes.sum()))
        found = np.array(list(self.machine.iter(self.text(numbers))), np.int64).reshape(-1, 2)
        ends, core = (found[:, 0] + 1) // 2, found[:, 1]
        times = self.counts[core]
        piece = self.pieces[np.repeat(self.heads[core] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        ends = np.repeat(ends, times)
        more = self.sizes[piece] - 1  # words of the piece on either side of its core
        starts, ahead, after = ends - (WINDOW - more), self.starts[piece] + more, self.starts[piece] + WINDOW
        padded = np.concatenate([np.full(SPAN, -2), numbers, np.full(SPAN, -2)])
        flat = np.concatenate([np.full(SPAN, -3), self.flat, np.full(SPAN, -3)])
        left, right = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
        for j in range(1, SPAN):
            left += (left == j - 1) & (j <= more) & (padded[SPAN + starts - j] == flat[SPAN + ahead - j])
            right += (right == j - 1) & (j <= more) & (padded[SPAN + ends + j - 1] == flat[SPAN + after + j - 1])
        starts, ends = starts - left, ends + right
        heads = np.cumsum(sizes) - sizes
        body = np.searchsorted(heads, starts, "right") - 1
        hit = (ends - starts >= WINDOW) & (self.firsts[self.owners[piece]] < keys[body]).astype(bool)
        order = np.lexsort((starts[hit], body[hit]))
        starts, ends, body = starts[hit][order], ends[hit][order], body[hit][order]
        if not len(starts):
            return none, none, none
        upto = np.maximum.accumulate(ends)  # bodies follow one another, so this is each body's own
        a, b = runs_of(np.append(True, (body[1:] != body[:-1]) | (starts[1:] > upto[:-1])))
        return body[a], starts[a] - heads[body[a]], upto[b] - heads[body[a]]


def located_spans(texts: DataFrame, passages: DataFrame, plan: DataFrame, shards: int, kind: str) -> DataFrame:
    """All occurrences of the passages' windows that their documents lose: k, v, start, end in words.

    ``plan``: parts and tasks of each shard.
    """
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    group = F.shiftleft(F.shiftleft("shard", SHARE) + F.col("part"), SHARE) + F.col("task")
    left = passages.withColumn("shard", F.pmod("slot", F.lit(shards))).join(plan, "shard").withColumn("part", F.pmod(F.xxhash64("body"), "parts")).withColumn(
        "task", upto("tasks")).select(group.alias("group"), F.col("first").alias("k"), F.lit(None).cast("bigint").alias("v"), F.lit(-1).cast("bigint").alias("at"), "body")
    right = stretches(texts, shards, kind).join(plan, "shard").withColumn("task", F.pmod(F.xxhash64("k", "v", "at"), "tasks")).withColumn(
        "part", upto("parts")).select(group.alias("group"), "k", "v", "at", "body")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, passage, automaton = None, [], None
        for batch in batches:
            first = 0
            for key, rows in groupby(zip(batch.column(0).to_pylist(), (at < 0 for at in batch.column(3).to_pylist()))):
                last = first + sum(1 for _ in rows)
                own = batch.slice(first, last - first)
                first = last
                if key[0] != current:
                    current, passage, automaton = key[0], [], None
                if key[1]:
                    passage.extend(zip(own.column(4).to_pylist(), own.column(1).to_pylist()))
                    continue
                if automaton is None:
                    automaton, passage = Automaton(passage), []
                body, start, end = automaton.located(own.column(4).to_pylist(), comparable(own.column(1).to_pylist()))
                at = own.column(3).to_numpy()[body]
                row = pa.array(body)
                yield pa.RecordBatch.from_arrays([own.column(1).take(row), own.column(2).take(row), pa.array(at + start), pa.array(at + end)],
                                                 ["k", "v", "start", "end"])

    ordered = left.unionByName(right).repartition("group").sortWithinPartitions("group", F.col("at") >= 0)
    return ordered.mapInArrow(each, f"k {kind}, v bigint, start bigint, end bigint")


def dealt(confirmed: DataFrame, loads: DataFrame, per_automaton: int, per_task: int) -> tuple[int, DataFrame]:
    """Number of shards, and the parts and tasks of each, from the phrases and the stretches (``loads``: slot, n) that were counted."""
    shards = max(1, min(1 << SLOT, -(-2 * confirmed.count() // per_automaton)))
    shard = lambda slot: F.pmod(slot, F.lit(shards)).alias("shard")
    share = lambda n, limit, name: F.least(F.ceil(n / limit), F.lit((1 << SHARE) - 1)).alias(name)
    parts = confirmed.groupBy(shard(F.col("h2").bitwiseAND((1 << SLOT) - 1))).agg(share(F.count("*"), per_automaton, "parts"))
    tasks = loads.groupBy(shard(F.col("slot"))).agg(share(F.sum("n"), per_task, "tasks"))
    return shards, materialize(parts.join(tasks, "shard"), "shards")


RESULT = "n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def without_spans(texts: DataFrame, spans: DataFrame, kind: str) -> DataFrame:
    """The result of texts (k, v, n_words, t) whose words lose the spans (k, v, start, end), which may overlap."""
    lists = spans.groupBy("k", "v").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, runs = [], [], []
            for text, rows in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words, kept, upto, lost = text.split(), [], 0, []
                for a, b in sorted((r["start"], r["end"]) for r in rows or []):
                    kept += words[upto:a]
                    if lost and a <= lost[-1]["end"]:
                        lost[-1]["end"] = max(b, lost[-1]["end"])
                    else:
                        lost.append({"start": a, "end": b})
                    upto = max(upto, b)
                kept += words[upto:]
                removed.append(len(words) - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                runs.append(lost)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(runs, span)],
                                             ["k", "n_words", "n_removed", "kept_sha256", "spans"])

    joined = texts.join(lists, ["k", "v"], "left").select("k", "n_words", "t", "spans")
    return joined.mapInArrow(each, f"k {kind}, {RESULT}")


def remove_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text", per_automaton: int = PHRASES, per_task: int = STRETCHES) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and spans (the removed runs of words), one row per row of docs."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    body = docs[text].cast("string")
    held = docs.select(docs[key].alias("k"), F.xxhash64(body).alias("v"), body.alias("t"))
    found = materialize(marks(held.filter("k IS NOT NULL"), kind), "marks")
    recurring = materialize(found.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("g"), "recurring")
    tidy(spark)
    grams = materialize(found.join(recurring, "g", "left_semi").groupBy("k").agg(F.collect_set("g").alias("grams")), "grams")
    tidy(spark, found, recurring)
    each = grams.select(F.explode("grams").alias("g")).groupBy(F.shiftrightunsigned("g", 64 - SLOT).alias("slot"))
    loads = materialize(each.agg(F.count("*").alias("n")), "loads")  # at most 2 ** SLOT rows
    texts = materialize(held_texts(held, grams, kind), "texts")
    tidy(spark, grams)
    some = texts.filter("grams IS NOT NULL")
    counted = window_rows(some, kind).groupBy("h1", "h2").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    confirmed = materialize(counted.filter("first < last").select("h1", "h2", "first"), "confirmed")
    tidy(spark)
    passages = materialize(passages_of(some, confirmed, kind), "passages")
    shards, plan = dealt(confirmed, loads, per_automaton, per_task)
    tidy(spark, confirmed, loads)
    spans = materialize(located_spans(some, passages, plan, shards, kind), "spans")
    tidy(spark, passages, plan)
    whole = texts.filter("grams IS NULL").select("k", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256",
                                                  F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return whole.unionByName(without_spans(some, spans, kind)).withColumnRenamed("k", key)
