"""Positions of regular-expression matches in whole texts, by DataFrame functions only.

Patterns are written so that Java's matcher neither recurses nor scans a run of characters more than once: groups
repeat possessively, and runs that could be long start where the run starts.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STEP = 1000  # matches are placed in groups of this size, so that a text with very many costs no square of them
SPAN = "array<struct<start:int,end:int,value:string>>"


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda n, v: n + v)


def matches(text: Column, pattern: str, present: Column) -> Column:
    """All matches left to right as (start, end, value) in code points, end exclusive; empty where ``present`` fails.

    A text is its pieces between matches and the matches in turn, so a start is the length of all before it.
    """
    found = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    found = F.filter(found, lambda x: x.m.isNotNull())

    def placed(start: Column, group: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(group, begin, lambda a, x: F.struct(
            (a.at + F.length(x.p) + F.length(x.m)).alias("at"),
            F.array_append(a.out, F.struct((a.at + F.length(x.p)).alias("start"), (a.at + F.length(x.p) + F.length(x.m)).alias("end"),
                                           x.m.alias("value"))).alias("out")), lambda a: a.out)

    def many(all_found: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(all_found), F.lit(STEP))
        starts = F.aggregate(steps, F.array(F.lit(0)), lambda a, s: F.array_append(a, F.element_at(a, -1) + total(
            F.transform(F.slice(all_found, s, F.lit(STEP)), lambda x: F.length(x.p) + F.length(x.m)))))
        return F.flatten(F.zip_with(steps, F.slice(starts, 1, F.size(steps)), lambda s, b: placed(b, F.slice(all_found, s, F.lit(STEP)))))

    # transform over a one-element array binds the matches once for all uses.
    every = F.flatten(F.transform(F.array(found), lambda x: F.when(F.size(x) <= STEP, placed(F.lit(0), x)).otherwise(many(x))))
    return F.when(present, every).otherwise(F.array().cast(SPAN))


def marked(kind: str, order: int, spans: Column) -> Column:
    """Spans with their kind and its place in the listing."""
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(order).alias("order"), s.end.alias("end"),
                                                 F.lit(kind).alias("kind"), s.value.alias("value")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o.start < span.end) & (span.start < o.end))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with every span replaced by ``mark``; overlapping spans are one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))))
    done = F.aggregate(ordered, F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("out")), lambda a, s: F.struct(
        F.greatest(a.upto, s.end).alias("upto"),
        F.when(s.start >= a.upto, F.concat(a.out, F.array(F.substring(text, a.upto + 1, s.start - a.upto), F.lit(mark)))).otherwise(a.out).alias("out")),
        lambda a: F.concat(F.array_join(a.out, ""), F.substring(text, a.upto + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
