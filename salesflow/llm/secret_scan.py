"""Secret scan: three base patterns, and strings of high sliding-window entropy.

Candidates are runs of hex digits, and runs of base-64 characters that are not hex, of at least a window's length. A
window of WIDTH characters slides over a candidate; of each character the count in the window is kept, and a step
changes only the counts of the character that enters and of the one that leaves. With S the sum of c * log2(c) over
the counts, the entropy is log2(WIDTH) - S / WIDTH. A candidate whose best window reaches its class's limit is a
secret, unless the allow-list knows it (plain words, numbers, placeholders). Of a candidate that base spans cover in
part, what lies outside of them is scanned in the same way; a rest shorter than a window is scanned with as much of the
candidate beside it as a window holds, unless it is a name before "=".

Null and empty texts have no spans. Every row gives one row, repeated rows alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesflow.llm.spans import marked, masked, matches, overlaps, written

KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYWORD + "[\"']?\\x20*+[:=]\\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
VALUE = "^" + KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?"
ACCESS, HEX = "AKIA[A-Z0-9]{16,}+", "[0-9a-f]{24,}+"
WIDTH = 20
CLASSES = {  # class: (run, characters, least entropy of a window)
    "entropy_hex": ("[0-9A-Fa-f]{20,}+", "0123456789abcdefABCDEF", 3.0),
    "entropy_base64": ("[A-Za-z0-9+/_=-]{20,}+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.75),
}
# Strings that are no secrets: one-case or capitalised words, words joined by marks, numbers, placeholders.
ALLOWED = "^(?:[A-Za-z]?[a-z]++|[A-Z]++|[0-9+/_=-]++|(?:[A-Z]?[a-z]++|[A-Z]++)(?:[+/_=-](?:[A-Z]?[a-z]*+|[A-Z]++|[0-9]++))++)$|(?i:example|sample|placeholder|changeme|dummy|xxxx|your[_-])"


def best_window(value: Column, characters: str, width: int = WIDTH) -> Column:
    """The largest Shannon entropy, in bits, of ``width`` consecutive characters; -1 for a shorter string."""
    part = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)
    letter = lambda i: F.instr(F.lit(characters), F.substring(value, i, F.lit(1)))
    start = F.struct(F.array_repeat(F.lit(0), len(characters)).alias("counts"), F.lit(0.0).alias("s"), F.lit(-1.0).alias("best"),
                     F.lit(0).alias("came"), F.lit(0).alias("left"))

    def slide(a: Column, i: Column) -> Column:
        came, left = letter(i), F.when(i > width, letter(F.greatest(i - width, F.lit(1)))).otherwise(0)
        # One-element arrays bind the two characters, then the new sum, so that each is worked out once.
        known = F.array(F.struct(came.alias("came"), left.alias("left")))
        stepped = F.transform(known, lambda k: F.struct(
            F.when(k.came == k.left, a.counts).otherwise(F.transform(a.counts, lambda v, j: v + (j + 1 == k.came).cast("int") - (
                j + 1 == k.left).cast("int"))).alias("counts"),
            F.when(k.came == k.left, a.s).otherwise(
                a.s + part(F.element_at(a.counts, k.came) + 1) - part(F.element_at(a.counts, k.came)) + F.when(
                    k.left > 0, part(F.element_at(a.counts, F.greatest(k.left, F.lit(1))) - 1) - part(
                        F.element_at(a.counts, F.greatest(k.left, F.lit(1))))).otherwise(0.0)).alias("s"),
            k.came.alias("came"), k.left.alias("left")))
        return F.element_at(F.transform(stepped, lambda n: F.struct(
            n.counts.alias("counts"), n.s.alias("s"),
            F.when(i >= width, F.greatest(a.best, F.log2(F.lit(float(width))) - n.s / width)).otherwise(a.best).alias("best"),
            n.came.alias("came"), n.left.alias("left"))), 1)

    return F.when(F.length(value) >= width, F.aggregate(F.sequence(F.lit(1), F.length(value)), start, slide, lambda a: a.best)).otherwise(-1.0)


def outside(span: Column, base: Column) -> Column:
    """The parts of ``span`` that no base span covers, each with ``look``, the text its windows slide over.

    ``base`` must be in order of start.
    """
    part = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    begin = F.struct(span.start.alias("upto"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    uncovered = F.aggregate(base, begin, lambda a, b: F.when((b.start >= span.end) | (b.end <= a.upto), a).otherwise(F.struct(
        b.end.alias("upto"), F.when(b.start > a.upto, F.array_append(a.out, part(a.upto, b.start))).otherwise(a.out).alias("out"))),
        lambda a: F.when(a.upto < span.end, F.array_append(a.out, part(a.upto, span.end))).otherwise(a.out))
    cut = lambda start, end: F.substring(span.value, start - span.start + 1, end - start)

    def looked(p: Column) -> Column:
        short = p.end - p.start < WIDTH
        first = F.when(short, F.greatest(span.start, p.start - WIDTH + 1)).otherwise(p.start)
        last = F.when(short, F.least(span.end, p.end + WIDTH - 1)).otherwise(p.end)
        return F.struct(p.start.alias("start"), p.end.alias("end"), cut(p.start, p.end).alias("value"), cut(first, last).alias("look"))

    name = lambda p: (p.end - p.start < WIDTH) & (p.end < span.end) & p.value.endswith("=")
    known = lambda p: p.value.rlike(ALLOWED) | F.btrim(p.value, F.lit("+/_=-")).rlike(ALLOWED)
    return F.filter(F.transform(uncovered, looked), lambda p: ~name(p) & ~known(p))


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``base`` and ``added``, arrays of (start, order, end, kind, value) in order of start."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    long_run = body.rlike("[A-Za-z0-9+/_=-]{20}")
    out = docs.withColumns({
        "_assign": F.filter(matches(body, ASSIGN, body.rlike(KEYWORD + "[\"']?\\x20*+[:=]")), lambda s: F.length(F.regexp_replace(s.value, VALUE, "")) >= 6),
        "_access": matches(body, ACCESS, F.contains(body, F.lit("AKIA"))),
        "_hex": matches(body, HEX, body.rlike("[0-9a-f]{24}")),
        "_eh": matches(body, CLASSES["entropy_hex"][0], long_run & body.rlike("[0-9A-Fa-f]{20}")),
        "_eb": matches(body, CLASSES["entropy_base64"][0], long_run)})
    out = out.withColumn("base", F.array_sort(F.concat(marked("assign", 0, F.col("_assign")), marked("access", 1, F.col("_access")),
                                                       marked("hex", 2, F.col("_hex")))))
    chosen = []
    for order, (kind, spans) in enumerate((("entropy_hex", "_eh"), ("entropy_base64", "_eb")), 3):
        _, characters, least = CLASSES[kind]
        hexed = lambda s: s.value.rlike("^[0-9A-Fa-f]++$") if order == 4 else F.lit(False)
        rest = F.filter(spans, lambda s: ~s.value.rlike(ALLOWED) & ~hexed(s))
        whole = lambda s: F.array(F.struct(s.start.alias("start"), s.end.alias("end"), s.value.alias("value"), s.value.alias("look")))
        rest = F.flatten(F.transform(rest, lambda s: F.when(overlaps(s, F.col("base")), outside(s, F.col("base"))).otherwise(whole(s))))
        # A part of WIDTH hex digits or more is one of entropy_hex.
        rest = F.filter(rest, lambda s: ~hexed(s) | (F.length(s.value) < WIDTH))
        chosen.append(marked(kind, order, F.filter(rest, lambda s: best_window(s.look, characters) >= least)))
    return out.withColumn("added", F.array_sort(F.concat(*chosen))).drop("_eh", "_eb")


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_added for each row."""
    found = secret_spans(docs.select(docs[key].alias(key), docs[text].alias("text")), "text")
    return found.select(
        key, *(F.size("_" + k).cast("long").alias("n_" + k) for k in ("assign", "access", "hex")),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def without_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in ``text`` replaced by ``mark``; the columns stay as they are."""
    names = docs.columns
    held = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text)
    found = secret_spans(held, f"c{at}")
    return found.select(*[(masked(F.col(f"c{i}"), F.concat("base", "added"), mark) if i == at else F.col(f"c{i}")).alias(c)
                          for i, c in enumerate(names)])
