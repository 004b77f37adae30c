"""Near duplicates by MinHash, with Odd Sketches to check candidates before the exact check.

A document is its set of distinct five-word shingles. BANDS x ROWS MinHash samples give BANDS bucket keys; two sets
of similarity 0.75 share no bucket with a chance of (1 - 0.75 ** 3) ** 28 = 2e-7. The samples are also folded into
an Odd Sketch: each flips one of 512 bits, so the bits in which two sketches differ count the samples in which the
sets differ. A second one, of 1024 bits, takes the whole set: its differing bits are never more than the shingles
that only one of the two sets has, of which a linked pair has at most a seventh of both sizes. A candidate is passed over
only if a count is out of reach for a linked pair, for certain or by more than 5.5 standard deviations; all others
are confirmed on their full sets.

Documents with the same set are one class, and only its smallest id goes on. In a bucket of many classes no pairs are
written out wholesale: each member is checked against one of the bucket, links are confirmed, components formed, and
only members of different components are compared again, three times against another member. What then is still apart in
one bucket is compared by its sketches, all with all but the members of the bucket's largest component among themselves:
members are dealt into blocks of bounded size, every two blocks meet in one cell, and a cell hands out only pairs that
their sketches allow. So no linked pair that shares a bucket is lost. Texts that are all a little too different from each other
(copies with many edits, or a passage with as much text of their own) leave no way round comparing each with each: the comparisons
in a bucket grow with its members times those outside its largest component, at 24 words of 64 bits each; rows moved are
a BLOCK-th of that, and neither a row per comparison nor their shingles are ever written.

Null or empty texts and texts without a word have no shingles and are linked with nothing. Rows that repeat an id
with the same text get the same result; rows that repeat it with other texts are one document, linked with
what any of them is linked with. A row without id is a component of its own (component_id null, kept).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from salesflow.llm.components import components
from salesflow.llm.steps import tidy
from salesflow.llm.textbytes import FOLDED, Words, batch_bytes, grams, lists, mix, signed, slices
from salesflow.session import materialize

WORDS, PERCENT = 5, 75
BANDS, ROWS, BITS, SET_BITS = 28, 3, 512, 1024
SIGMAS = 5.5
PER_COPY = 500  # pairs of one document that meet one copy of its row
ROUNDS = 3
BLOCK = 1024  # members of a bucket that meet as many others in one cell
STEP = 1 << 15  # comparisons made at once
_draw = np.random.Generator(np.random.PCG64(20240229))
FLIPS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def most_bits(percent: int = PERCENT) -> int:
    """Bits in which the sketches of two linked sets differ at most, but for chances beyond SIGMAS."""
    k, apart = BANDS * ROWS, 1 - percent / 100
    samples = k * apart + SIGMAS * math.sqrt(k * apart * (1 - apart))
    expected = BITS / 2 * (1 - math.exp(-4 * samples / BITS))
    return math.ceil(expected + SIGMAS * math.sqrt(expected) / 2)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    words = Words(data, bounds, FOLDED)
    found = grams(words.hashes, n)
    begins = np.cumsum(words.counts) - words.counts
    out = []
    for begin, count in zip(begins, words.counts):
        if count >= n:
            out.append(np.unique(found[begin:begin + count - n + 1]))
        elif count:
            out.append(grams(words.hashes[begin:begin + count], int(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def samples_of(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, one row a set; sets must not be empty."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for j in range(BANDS * ROWS):
        out[:, j] = np.minimum.reduceat((flat ^ FLIPS[j]) * FACTORS[j], begins)
    return out


def sketches_of(samples: np.ndarray) -> np.ndarray:
    """Odd Sketches as 64-bit words, one row a set."""
    n, k = samples.shape
    spread = mix(samples + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = (spread >> np.uint64(64 - 9)).astype(np.int64) + np.arange(n)[:, None] * BITS
    odd = (np.bincount(at.ravel(), minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, BITS), axis=1).view(np.int64)


def parities_of(sets: list[np.ndarray]) -> np.ndarray:
    """Odd Sketches of the whole sets, one row a set."""
    at = (mix(np.concatenate(sets) + np.uint64(77)) >> np.uint64(64 - 10)).astype(np.int64)
    at += np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * SET_BITS
    odd = (np.bincount(at, minlength=len(sets) * SET_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), SET_BITS), axis=1).view(np.int64)


def most_parity(sizes, percent: int, root, exp, least):
    """Bits in which whole-set sketches of two linked sets of ``sizes`` shingles in all differ at most.

    ``root``, ``exp`` and ``least`` are those of NumPy or of Spark's columns.
    """
    differ = sizes * (100 - percent) / (100 + percent)
    odd = (1 - exp(differ * (-2 / SET_BITS))) / 2
    return least(differ, SET_BITS * odd + SIGMAS * root(SET_BITS * odd * (1 - odd)) + 1) + 1e-6


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key k, hash v of the text, n shingles, set hashes h1 h2, band keys and sketch (null without shingles) for each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = batch_bytes(batch.column(1))
            for first, last in slices(bounds):
                sets = shingle_sets(data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first])
                full = np.array([len(s) > 0 for s in sets])
                h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                h2 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                bands, sketch = np.zeros((0, BANDS), np.int64), np.zeros((0, BITS // 64), np.int64)
                parity = np.zeros((0, SET_BITS // 64), np.int64)
                if full.any():
                    samples = samples_of([s for s in sets if len(s)])
                    mixed = np.zeros((len(samples), BANDS), np.uint64)
                    for r in range(ROWS):
                        mixed = mix(mixed * np.uint64(0xC2B2AE3D27D4EB4F) + samples[:, r::ROWS])
                    bands = signed(mix(mixed + np.arange(BANDS, dtype=np.uint64)))
                    sketch = sketches_of(samples)
                    parity = parities_of([s for s in sets if len(s)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(signed(h1)), pa.array(signed(h2)), lists(bands.ravel(), full * BANDS, pa.int64()),
                     lists(sketch.ravel(), full * (BITS // 64), pa.int64()),
                     lists(parity.ravel(), full * (SET_BITS // 64), pa.int64())], ["k", "v", "n", "h1", "h2", "bands", "sketch", "parity"])

    kind = docs.schema[key].dataType.simpleString()
    body = docs[text].cast("string")
    return docs.select(docs[key].alias("k"), body.alias("t"), F.xxhash64(body).alias("v")).mapInArrow(
        each, f"k {kind}, v bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>, sketch array<bigint>, parity array<bigint>")


def set_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k and its full shingle set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = batch_bytes(batch.column(1))
            for first, last in slices(bounds):
                sets = shingle_sets(data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first),
                     lists(signed(np.concatenate(sets)), np.array([len(s) for s in sets]), pa.int64())], ["k", "items"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).mapInArrow(each, f"k {kind}, items array<bigint>")


def apart(left: str, right: str) -> F.Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def joined(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (a, b) joined with ``right`` on b and with ``left`` on a. An ``a`` of many pairs is dealt out by b, and its row copied as often."""
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_COPY).alias("copies")).filter("copies > 1")
    own = F.coalesce(F.col("copies"), F.lit(1).cast("bigint"))
    dealt = pairs.join(hot, "a", "left").withColumn("copy", F.pmod(F.xxhash64("b"), own)).drop("copies")
    copied = left.join(hot, "a", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), own - 1))).drop("copies")
    return dealt.join(right, "b").join(copied, ["a", "copy"]).drop("copy")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    left = reps.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("parity").alias("pa"))
    right = reps.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("parity").alias("pb"))
    both = joined(pairs, left, right)
    return both.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (apart("sa", "sb") <= most_bits(percent))
                       & (apart("pa", "pb") <= most_parity(F.col("na") + F.col("nb"), percent, F.sqrt, F.exp, F.least))).select("a", "b")


def sets_of(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """k and full shingle set of the documents named in ``wanted`` (k)."""
    held = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).join(wanted, "k", "left_semi")
    return set_rows(held, "k", "t")


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Those pairs whose full sets are similar enough; sets are made for the documents in question only."""
    sets = materialize(sets_of(docs, key, text, pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()), "sets")
    left, right = sets.select(F.col("k").alias("a"), F.col("items").alias("x")), sets.select(F.col("k").alias("b"), F.col("items").alias("y"))
    both = joined(pairs, left, right)
    shared = F.size(F.array_intersect("x", "y"))
    found = materialize(both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y") - shared).alias("u")).filter(
        (F.col("a") != F.col("b")) & (100 * F.col("i") >= percent * F.col("u"))).select("a", "b").distinct(), "links")
    tidy(found.sparkSession, sets)
    return found


def cells(rest: DataFrame, reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members (bucket, k, comp) with size and sketches, one copy for each cell (bucket, i, j) they are compared in.

    Those outside the bucket's largest component are dealt into blocks 0 to outer - 1, those inside into the blocks behind. Block i
    meets block j in one cell for i <= j and i < outer. A bucket of at most ``block`` members is one block.
    """
    sizes = rest.groupBy("bucket", "comp").agg(F.count("*").alias("m")).groupBy("bucket").agg(
        F.max(F.struct("m", "comp")).alias("home"), F.sum("m").alias("m"))
    whole, blocks = F.col("m") <= block, lambda m: F.ceil(m / block).cast("bigint")
    spread = sizes.select(
        "bucket", F.when(~whole, F.col("home.comp")).alias("home"), F.when(whole, 1).otherwise(blocks(F.col("m") - F.col("home.m"))).alias("outer"),
        F.when(whole, 0).otherwise(blocks(F.col("home.m"))).alias("inner"))
    dealt = rest.join(spread, "bucket").withColumn("at", F.when(
        F.col("comp") == F.col("home"), F.col("outer") + F.pmod(F.xxhash64("k"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("k"), F.col("outer"))))
    others = F.when(F.col("at") < F.col("outer"), F.col("outer") + F.col("inner")).otherwise(F.col("outer"))
    copies = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), others - 1)))
    return copies.select("bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "k", "comp").join(reps, "k")


def allowed(x: tuple, y: tuple | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and ``y`` of the pairs of different components whose sizes and sketches allow a link; without ``y``, of pairs in ``x``.

    Either is (component, size, sketches, whole-set sketches).
    """
    (comp, n, sketch, parity), bits = x, most_bits(percent)
    comp_y, n_y, sketch_y, parity_y = x if y is None else y
    step, found = max(1, STEP // max(1, len(n_y))), []
    for first in range(0, len(n), step):
        last, behind = first + step, first if y is None else 0
        low, high = np.minimum(n[first:last, None], n_y[None, behind:]), np.maximum(n[first:last, None], n_y[None, behind:])
        a, b = np.nonzero((comp[first:last, None] != comp_y[None, behind:]) & (100 * low >= percent * high))
        a, b = a + first, b + behind
        if y is None:
            a, b = a[a < b], b[a < b]
        near = np.bitwise_count(sketch[a] ^ sketch_y[b]).sum(axis=1, dtype=np.int64) <= bits
        a, b = a[near], b[near]
        differ = np.bitwise_count(parity[a] ^ parity_y[b]).sum(axis=1, dtype=np.int64)
        near = differ <= most_parity((n[a] + n_y[b]).astype(float), percent, np.sqrt, np.exp, np.minimum)
        found.append((a[near], b[near]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def block_pairs(rest: DataFrame, reps: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of members of one bucket and different components whose sizes and sketches allow a link."""

    def compare(cell: pa.Table) -> pa.RecordBatch:
        words = lambda name: cell[name].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(cell), -1)
        comp, n = cell["comp"].combine_chunks().dictionary_encode().indices.to_numpy(), cell["n"].to_numpy()
        sketch, parity = words("sketch"), words("parity")
        k, at = cell["k"].combine_chunks(), cell["at"].to_numpy()
        left = np.nonzero(at == cell["i"][0].as_py())[0]
        right = np.nonzero(at == cell["j"][0].as_py())[0]
        of = lambda rows: (comp[rows], n[rows], sketch[rows], parity[rows])
        same = cell["i"][0] == cell["j"][0]
        a, b = allowed(of(left), None if same else of(right), percent)
        return pa.RecordBatch.from_arrays([k.take(pa.array(left[a])), k.take(pa.array(right[b]))], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last cell may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            keys = np.stack([rows[c].to_numpy() for c in ("bucket", "i", "j")])
            bounds = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist()]
            for first, last in zip(bounds, bounds[1:]):
                if last - first > 1:
                    yield compare(rows.slice(first, last - first))
            held = rows.slice(bounds[-1])
        if held is not None and len(held) > 1:
            yield compare(held)

    kind = rest.schema["k"].dataType.simpleString()
    by = ["bucket", "i", "j"]
    met = cells(rest, reps, block).repartition(*by).sortWithinPartitions(*by).mapInArrow(each, f"a {kind}, b {kind}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def prefix_pairs(members: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Pairs of members (k, comp) of different components that can be linked, by their rarest shingles.

    Of the smaller set of a linked pair at least 2 t / (1 + t) is shared, of the larger one t. So the rarest shared shingle is among
    the first n - ceil(2 t n / (1 + t)) + 1 of the smaller and the first n - ceil(t n) + 1 of the larger, in any order that is the
    same for all. Rows that repeat an id have each text's set.
    near_duplicates does without: in a group of edited copies the rarest shingles that are shared are shared by nearly all.
    """
    sets = sets_of(docs, key, text, members.select("k")).join(members, "k")
    items = materialize(sets.filter(F.size("items") > 0).select(
        "k", "comp", F.xxhash64("items").alias("set"), F.size("items").alias("n"), F.explode("items").alias("item")), "shingles")
    rare = items.groupBy("item").agg(F.count("*").alias("times"))
    order = Window.partitionBy("k", "set").orderBy("times", "item")
    n, least, smaller = F.col("n"), F.ceil(F.col("n") * percent / 100 - 1e-9), F.ceil(F.col("n") * (2 * percent / (100 + percent)) - 1e-9)
    ranked = items.join(rare, "item").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= n - least + 1)
    ranked = materialize(ranked.select("k", "comp", "n", "item", (F.col("at") <= n - smaller + 1).alias("early")), "rarest")
    x, y = ranked.alias("x"), ranked.filter("early").alias("y")
    met = F.expr("x.item = y.item AND x.comp <> y.comp") & (F.col("y.n") <= F.col("x.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
    pairs = materialize(x.join(y, met).select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b")).distinct(), "met")
    tidy(pairs.sparkSession, items, ranked)
    return pairs


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, text_hash: bool = False) -> DataFrame:
    """key, n_shingles, component_id (smallest id reachable) and kept, one row per row of docs; ``text_hash`` adds the text's hash."""
    spark = docs.sparkSession
    found = materialize(signatures(docs, key, text), "signatures")
    sets = found.filter("n > 0 AND k IS NOT NULL")
    classes = materialize(sets.groupBy("h1", "h2").agg(F.min("k").alias("rep")), "classes")
    reps = sets.join(classes, ["h1", "h2"]).filter("k = rep").dropDuplicates(["k", "h1", "h2"]).select("k", "n", "bands", "sketch", "parity")
    entries = reps.select("k", F.explode("bands").alias("bucket"))
    full = entries.groupBy("bucket").agg(F.min("k").alias("lead"), F.count("*").alias("m")).filter("m > 1")
    members = materialize(entries.join(full.select("bucket", "lead"), "bucket"), "members")
    small = materialize(reps.select("k", "n", "sketch", "parity").join(members.select("k").distinct(), "k", "left_semi"), "reps")

    stars = materialize(members.filter("k <> lead").select(F.col("lead").alias("a"), F.col("k").alias("b")).distinct(), "stars")
    first = materialize(likely(stars, small, percent), "likely")
    links = confirmed(first, docs, key, text, percent)
    tidy(spark, stars, first)
    labels = components(links)
    seen = None
    for turn in range(1, ROUNDS + 2):
        known = members.select("bucket", "k").join(labels, F.col("k") == F.col("node"), "left").select(
            "bucket", "k", F.coalesce("comp", "k").alias("comp"))
        open_buckets = known.groupBy("bucket").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"),
            F.min(F.struct(F.xxhash64("k", F.lit(turn)).alias("r"), "k", "comp")).alias("lead")).filter("low <> high")
        rest = materialize(known.join(open_buckets.select("bucket", "lead"), "bucket"), "open")
        if rest.isEmpty():
            break
        if turn <= ROUNDS:
            met = materialize(rest.filter("comp <> lead.comp").select(
                F.least("k", "lead.k").alias("a"), F.greatest("k", "lead.k").alias("b")).distinct(), "met")
            pairs = likely(met, small, percent)
        else:
            pairs = met = materialize(block_pairs(rest.select("bucket", "k", "comp"), small, percent), "met")
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "likely")
        tidy(spark, rest, met)
        seen = pairs if seen is None else seen.union(pairs)
        if pairs.isEmpty():
            continue
        more = confirmed(pairs, docs, key, text, percent)
        if not more.isEmpty():
            links = links.union(more)
            before, labels = labels, components(links)
            tidy(spark, before)
    tidy(spark, members, small)

    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("comp", "rep").alias("comp"))
    out = found.filter("n > 0").join(named, ["h1", "h2"], "left").select("k", "v", "n", "comp").union(
        found.filter("n = 0").select("k", "v", "n", F.lit(None).alias("comp")))
    comp = F.when(F.col("k").isNotNull(), F.coalesce("comp", "k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.coalesce(F.col("k") == comp, F.lit(True)).alias("kept"), *([F.col("v").alias("text_hash")] if text_hash else []))


# The same on DuckDB, with all shared shingles counted; for small tables.
SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach (a, b) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least_of AS (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least_id, doc_id) AS component_id, coalesce(least_id, doc_id) = doc_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""
