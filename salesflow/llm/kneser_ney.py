"""Interpolated modified Kneser-Ney model of characters, trained on trusted texts, one model a language.

Trusted texts: the ids that the labels trust set bits in a bitmap of fixed size (2 MB whatever their number), which lets
tasks pass over most other texts before those that are left meet the exact ids in a join; a full bitmap would pass more texts
and change nothing.

Counts: each task counts the n-grams of its texts (orders 1 to ORDER, padded at both ends), counts are added up by
n-gram. Orders below the highest count the different symbols seen to their left instead. Discounts D1, D2, D3+ come from the
counts of counts of each language and order. All of that is joins and sums over n-gram tables on the executors.

Scoring: the model is dealt into shards by the two symbols ahead of the last one (orders 1 and 2, which are small, go
to every shard), so a position of a text needs one shard only. The number of shards grows with the model so that each
has about SHARD_ROWS rows, measured before it is sent; the texts are scanned once a shard, each scan scores the positions of
its shard, and the partial sums are added per document. Perplexity is exp of the mean negative log-probability.

A language's limit is the QUANTILE of the perplexities of its trusted texts, times SLACK; documents above it are
rejected. Texts that are null or empty have no perplexity and are not kept. A null language is one of its own. A
language without trusted texts has no model: perplexity and limit null, kept. Every row gives one row, rows that
repeat an id and text alike; other columns are ignored. Trusted rows repeated by the labels count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from salesflow.llm.textbytes import mix, signed
from salesflow.session import materialize

ORDER, QUANTILE, SLACK = 4, 0.99, 1.05
SHARD_ROWS = 1_000_000
SLICE_CHARS = 1 << 18
BITS, BUCKET = 24, 32768  # of the bitmap; bits in a row of Spark's bitmap aggregate
START, END, DIGIT, SPACE = 1, 2, 3, 32
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def symbols(texts: list[str | None], langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with ORDER - 1 starts before and an end after each; the text and the language hash of each.

    Digits are one symbol, ASCII white space another.
    """
    parts, counts = [], []
    for t in texts:
        codes = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
        parts += [np.full(ORDER - 1, START, np.uint32), codes, np.full(1, END, np.uint32)]
        counts.append(len(codes) + ORDER)
    flat = np.concatenate(parts).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    inner = np.concatenate([[False] * (ORDER - 1) + [True] * (c - ORDER) + [False] for c in counts])
    flat[inner & (flat >= 48) & (flat <= 57)] = DIGIT
    flat[inner & (flat >= 9) & (flat <= 13)] = SPACE
    return flat, doc, langs[doc]


def gram_keys(flat: np.ndarray, lang: np.ndarray, at: np.ndarray, n: int, back: int = 0) -> np.ndarray:
    """Hash of the ``n`` symbols that end ``back`` before each position."""
    out = lang[at] + np.uint64(n)
    for j in range(n - 1, -1, -1):
        out = (out ^ flat[at - j - back]) * FACTOR
        out ^= out >> np.uint64(29)
    return mix(out)


def shard_of(flat: np.ndarray, lang: np.ndarray, at: np.ndarray, shards: int) -> np.ndarray:
    return (gram_keys(flat, lang, at, 2, 1) % np.uint64(shards)).astype(np.int64)


def lang_hash(names) -> np.ndarray:
    import zlib

    return mix(np.array([zlib.crc32(b"" if x is None else b"l" + x.encode()) for x in names], np.uint64))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[str]]]:
    """Rows with a text in groups of about SLICE_CHARS characters: batch, row numbers and texts."""
    for batch in batches:
        rows, texts, held = [], [], 0
        for i, value in enumerate(batch.column(1)):
            text = value.as_py()
            if text:
                rows.append(i)
                texts.append(text)
                held += len(text)
            if held > SLICE_CHARS:
                yield batch, rows, texts
                rows, texts, held = [], [], 0
        if rows:
            yield batch, rows, texts


def trusted_texts(docs: DataFrame, good: DataFrame) -> DataFrame:
    """Rows of docs (k, t, lang) whose id is in ``good`` (k)."""
    bit = F.pmod(F.xxhash64("k"), F.lit(1 << BITS))
    rows = good.groupBy(F.floor(bit / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(bit % BUCKET).alias("part")).collect()
    marks = np.zeros(1 << BITS >> 3, np.uint8)  # at most 2 ** BITS bits
    for r in rows:
        marks[r.bucket * BUCKET // 8:(r.bucket + 1) * BUCKET // 8] = np.frombuffer(r.part, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks.tobytes())

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            bits = batch.column(3).to_numpy()
            yield batch.filter(pa.array((known[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1))

    likely = docs.select("k", "t", "lang", bit.alias("bit"))
    return likely.mapInArrow(marked, likely.schema).drop("bit").join(good, "k", "left_semi")


def gram_counts(trusted: DataFrame) -> DataFrame:
    """(lang, n, h, ctx, suf, mid, c) of the n-grams of trusted (k, t, lang): the n-gram, its history, its ending, the shard key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, texts in grouped(batches):
            names = batch.column(2).take(pa.array(rows)).to_pylist()
            flat, doc, lang = symbols(texts, lang_hash(names))
            ends = np.flatnonzero(np.arange(len(flat)) - np.searchsorted(doc, doc) >= ORDER - 1)
            top = gram_keys(flat, lang, ends, ORDER)
            _, first, times = np.unique(top, return_index=True, return_counts=True)
            at = ends[first]
            for n in range(ORDER, 0, -1):  # shorter n-grams come from the different longer ones
                keys = gram_keys(flat, lang, at, n)
                _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
                times = np.bincount(inverse, times).astype(np.int64)
                at = at[index]
                tongue = pa.array(names).take(pa.array(doc[at]))
                yield pa.RecordBatch.from_arrays(
                    [tongue.cast(pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(signed(keys[index])), pa.array(signed(gram_keys(flat, lang, at, n - 1, 1))),
                     pa.array(signed(gram_keys(flat, lang, at, n - 1))), pa.array(signed(gram_keys(flat, lang, at, 2, 1))), pa.array(times)],
                    ["lang", "n", "h", "ctx", "suf", "mid", "c"])

    parts = trusted.mapInArrow(each, "lang string, n int, h bigint, ctx bigint, suf bigint, mid bigint, c bigint")
    return parts.groupBy("n", "h").agg(F.first("lang").alias("lang"), F.first("ctx").alias("ctx"), F.first("suf").alias("suf"),
                                       F.first("mid").alias("mid"), F.sum("c").alias("c"))


def train(trusted: DataFrame) -> DataFrame:
    """The model: rows (lang, n, h, mid, seen, value). seen: an n-gram with its discounted probability; else a history of order n with its weight.

    ``value`` of order 0 is the share of each symbol in an even distribution over the language's symbols.
    """
    grams = materialize(gram_counts(trusted), "grams")
    left = grams.filter("n > 1").groupBy((F.col("n") - 1).alias("n"), F.col("suf").alias("h")).agg(F.count("*").alias("left"))
    used = grams.join(left, ["n", "h"], "left").withColumn("c", F.when(F.col("n") < ORDER, F.coalesce("left", F.lit(0))).otherwise(F.col("c"))).filter("c > 0")
    tally = used.groupBy("lang", "n").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    rate = lambda i: F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.0), F.lit(i) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))
    discounts = tally.select("lang", "n", *[F.least(F.coalesce(rate(i), F.lit(0.5)), F.lit(float(i))).alias(f"d{i}") for i in (1, 2, 3)])
    used = used.join(discounts, used.lang.eqNullSafe(discounts.lang) & (used.n == discounts.n)).select(used["*"], "d1", "d2", "d3")
    off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    histories = used.groupBy("n", "ctx").agg(F.first("lang").alias("lang"), F.first("mid").alias("mid"), F.sum("c").alias("all"), F.sum(off).alias("off"))
    seen = used.join(histories.select("n", "ctx", "all"), ["n", "ctx"]).select(
        "lang", "n", "h", "mid", F.lit(True).alias("seen"), ((F.col("c") - off) / F.col("all")).alias("value"))
    weights = histories.select("lang", "n", F.col("ctx").alias("h"), "mid", F.lit(False).alias("seen"), (F.col("off") / F.col("all")).alias("value"))
    even = used.filter("n = 1").groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("value")).select(
        "lang", F.lit(0).alias("n"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("mid"), F.lit(True).alias("seen"), "value")
    return materialize(seen.unionByName(weights).unionByName(even), "model")


def shard_arrays(rows: pa.Table) -> dict:
    """Per (order, seen): sorted keys and their values, for one shard; and the even share by language hash."""
    out = {}
    n, seen = rows["n"].to_numpy(), rows["seen"].to_numpy(zero_copy_only=False)
    keys, values = rows["h"].to_numpy().view(np.uint64), rows["value"].to_numpy()
    for order in range(1, ORDER + 1):
        for kind in (True, False):
            pick = (n == order) & (seen == kind)
            sort = np.argsort(keys[pick])
            out[order, kind] = keys[pick][sort], values[pick][sort]
    base = n == 0
    out["even"] = dict(zip(lang_hash(rows["lang"].filter(pa.array(base)).to_pylist()).tolist(), values[base].tolist())) if base.any() else {}
    return out


def looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    known, values = table
    if not len(known):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], missing)


def log_probabilities(model: dict, flat: np.ndarray, lang: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log-probability of the symbol at each position, each different n-gram worked out once."""
    _, first, inverse = np.unique(gram_keys(flat, lang, at, ORDER), return_index=True, return_inverse=True)
    once = at[first]
    tongues, which = np.unique(lang[once], return_inverse=True)
    p = np.array([model["even"].get(int(x), np.nan) for x in tongues])[which] if len(once) else np.zeros(0)
    for n in range(1, ORDER + 1):
        weight = looked_up(model[n, False], gram_keys(flat, lang, once, n - 1, 1), 1.0)
        p = looked_up(model[n, True], gram_keys(flat, lang, once, n), 0.0) + weight * p
    return np.log(p)[inverse]


def score(docs: DataFrame, model: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(k, v, lang, total, symbols) for each row of docs (k, t, lang): summed log-probability and symbols scored."""
    spark = docs.sparkSession
    small, large = (model.filter(f"n {x} 2") for x in ("<=", ">"))
    shards = max(1, -(-large.count() // shard_rows))
    deal = F.expr(f"cast(pmod(cast(mid as decimal(20)) + if(mid < 0, 18446744073709551616, 0), {shards}) as int)")
    kind = docs.schema["k"].dataType.simpleString()
    scored = None
    for shard in range(shards):
        rows = large.filter(deal == shard).unionByName(small).select("lang", "n", "h", "seen", "value").toArrow()
        shared = spark.sparkContext.broadcast(shard_arrays(rows))

        def each(batches, shared=shared, shard=shard):
            for batch in batches:
                total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                for _, row, texts in grouped([batch]):
                    flat, doc, lang = symbols(texts, lang_hash(batch.column(2).take(pa.array(row)).to_pylist()))
                    at = np.flatnonzero(np.arange(len(flat)) - np.searchsorted(doc, doc) >= ORDER - 1)
                    if shards > 1:
                        at = at[shard_of(flat, lang, at, shards) == shard]
                    logs = log_probabilities(shared.value, flat, lang, at)
                    total[row] += np.bincount(doc[at], logs, len(texts))
                    count[row] += np.bincount(doc[at], minlength=len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(total), pa.array(count)],
                                                 ["k", "lang", "v", "total", "symbols"])

        part = docs.select("k", "t", "lang", F.xxhash64("t").alias("v")).mapInArrow(
            each, f"k {kind}, lang string, v bigint, total double, symbols bigint")
        scored = part if scored is None else scored.unionByName(part)
    if shards > 1:  # rows that repeat a document were scored as often: the mean per row is what each of them gets
        scored = scored.groupBy("k", "lang", "v").agg(F.sum("total").alias("total"), F.sum("symbols").alias("symbols"), F.count("*").alias("times")).withColumn(
            "times", F.col("times") / shards)
        scored = scored.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(
            "k", "lang", "v", (F.col("total") / F.col("times")).alias("total"), (F.col("symbols") / F.col("times")).cast("long").alias("symbols"))
    return scored


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                   quantile: float = QUANTILE, slack: float = SLACK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """key, lang, n_symbols, perplexity, threshold and kept, one row per row of docs.

    labels: (key, quality, toxic); texts of quality 1 that are not toxic are trusted.
    """
    held = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"), docs[lang].cast("string").alias("lang"))
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(labels[key].alias("k")).filter("k IS NOT NULL").distinct()
    model = train(trusted_texts(held, good))
    scored = materialize(score(held, model, shard_rows).withColumn("perplexity", F.when(F.col("symbols") > 0, F.round(F.exp(-F.col("total") / F.col("symbols")), 6))).withColumn(
        "perplexity", F.when(~F.isnan("perplexity"), F.col("perplexity"))), "scores")
    limits = scored.join(good, "k", "left_semi").groupBy("lang").agg(
        (F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000)) * slack).alias("threshold")).filter("threshold IS NOT NULL")
    a, b = scored.alias("a"), limits.alias("b")
    out = a.join(b, F.expr("a.lang <=> b.lang"), "left").select("a.*", "b.threshold")
    kept = (F.col("symbols") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select(F.col("k").alias(key), "lang", F.col("symbols").alias("n_symbols"), "perplexity", F.round("threshold", 6).alias("threshold"), kept.alias("kept"))
