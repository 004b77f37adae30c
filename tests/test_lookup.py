"""Paging by the last row, search by trigrams, days as bitmaps."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rows import table
from salesflow.operators import days, keyed, search
from salesflow.session import scratch_path
from salesflow.sources.folders import names_in

ORDER = [("at", True), ("id", False)]


def all_pages(read, limit):
    out, last = [], None
    while True:
        page = keyed.seek(read(len(out)), ORDER, last, limit)
        rows = [tuple(r) for r in page.collect()]
        if not rows:
            return out
        out.append(rows)
        last = keyed.cursor(page, ORDER)


def test_pages_by_the_last_row_are_the_table(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, 1, 2, 3, 3, 3])) for i in range(57)]
    df = spark.createDataFrame(rows, "id int, at int").repartition(3)
    got = all_pages(lambda n: df, 10)
    want = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -9), r[0]))
    assert [r for p in got for r in p] == want and [len(p) for p in got] == [10] * 5 + [7]


def test_rows_added_meanwhile_hide_and_repeat_nothing(spark):
    rows = [(i, i % 5) for i in range(40)]
    added = lambda n: [(1000 + i, 9) for i in range(3 * n)]
    got = all_pages(lambda n: spark.createDataFrame(rows + added(n), "id int, at int"), 8)
    flat = [r for p in got for r in p]
    assert sorted(flat) == sorted(rows) and len(flat) == len(set(flat))


def test_a_later_page_is_a_filter_and_a_top_k(spark, tmp_path):
    spark.range(5000).select(F.col("id").cast("int").alias("id"), (F.col("id") % 100).cast("int").alias("at")).write.parquet(str(tmp_path / "t"))
    page = keyed.seek(spark.read.parquet(str(tmp_path / "t")), ORDER, [3, 17], 50)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "LessThanOrEqual(at,3)" in plan and "Offset" not in plan


def names(spark, rows):
    return spark.createDataFrame(rows, "user_id string, sku string, product_name string")


NAMES = [("u1", "a", "Spring Onion"), ("u1", "b", "RINGS"), ("u1", "c", "ring of 100%"), ("u1", "d", "R_NG"), ("u2", "a", "Earring"), ("u1", "e", None),
         ("u1", "f", "ok"), ("u1", "g", ""), ("u2", "h", "Größe Ring"), ("u1", "i", "ri ng ing")]


@pytest.mark.parametrize("text", ["ring", "RING", "r_ng", r"r\_ng", "100%", r"100\%", "o", "ok", "%", "in%on", "größe", "xyz", "ing", "ri", r"\\"])
def test_search_equals_ilike(spark, text):
    path = scratch_path(spark, "postings")
    search.index_names(names(spark, NAMES), path)
    for tenant in ("u1", None):
        want = names(spark, NAMES).filter(F.col("product_name").ilike(f"%{text}%"))
        want = want if tenant is None else want.filter(F.col("user_id") == tenant)
        assert table(search.search_names(spark, path, names(spark, NAMES), text, tenant)) == table(want)


def test_grams_are_those_of_plain_pieces():
    assert search.plain_pieces(r"Ab%c\%d_e\\") == ["ab", "c%d", "e\\"] and search.pattern_grams("abcd%xyz_ab") == ["abc", "bcd", "xyz"]
    assert search.pattern_grams("ab") == [] == search.pattern_grams("")


def test_changed_names_are_found_by_what_they_are_now(spark):
    path = scratch_path(spark, "postings")
    search.index_names(names(spark, [("u1", "a", "old cup"), ("u1", "b", "blue mug")]), path)
    now = names(spark, [("u1", "a", "new mug"), ("u1", "b", "blue mug")])
    search.index_names(now.filter("sku = 'a'"), path)
    assert table(search.search_names(spark, path, now, "mug"), "sku") == [("a",), ("b",)]
    assert search.search_names(spark, path, now, "cup").count() == 0


def test_days_are_counted_once(spark):
    rnd, path, want = random.Random(6), scratch_path(spark, "days"), {}
    first = date(1960, 1, 1)
    for _ in range(4):
        rows = [(f"u{rnd.randrange(2)}", f"s{rnd.randrange(5)}", first + timedelta(rnd.randrange(60000))) for _ in range(80)] + [("u0", "s0", None)]
        rows += rows[:10]
        days.add_days(spark, spark.createDataFrame(rows, "user_id string, sku string, date date"), path)
        for u, k, d in rows:
            if d:
                want.setdefault((u, k), set()).add(d)
    got = {(r.user_id, r.sku): (r.sales_days, r.last_sale_date) for r in days.day_stats(spark.read.schema(days.DAYS).parquet(path)).collect()}
    assert got == {k: (len(v), max(v)) for k, v in want.items()}


def test_an_upload_touches_the_folders_of_its_series(spark):
    path = scratch_path(spark, "days")
    many = spark.range(200).select(F.lit("u").alias("user_id"), F.concat(F.lit("s"), "id").alias("sku"), F.lit("2026-07-01").cast("date").alias("date"))
    days.add_days(spark, many, path)
    before = {n: names_in(spark, f"{path}/{n}") for n in names_in(spark, path) if n.startswith("part=")}
    upload = many.filter("sku IN ('s1', 's2')").withColumn("date", F.lit("2026-07-02").cast("date"))
    days.add_days(spark, upload, path)
    assert sum(names_in(spark, f"{path}/{n}") != files for n, files in before.items()) <= 2 < len(before)
    assert table(days.touched_stats(spark, path, upload)) == [("u", "s1", 2, "2026-07-02"), ("u", "s2", 2, "2026-07-02")]
