"""Queries: column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesflow.catalog.registry import query
from salesflow.functions import scalars as fn


@query("scalar_strings", """
    SELECT o_orderkey, substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS tail,
           split_part(o_orderpriority, '-', 1) AS head, concat_ws(':', o_orderstatus, o_custkey) AS key,
           upper(trim(concat(' ', lower(o_orderpriority), ' '))) AS shouted,
           CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'none' END AS chosen,
           starts_with(o_orderpriority, '1') AS urgent, replace('lag_roll_mean', '_', ' ') AS label,
           contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high') AS hinted,
           regexp_full_match(concat('B', lpad(CAST(o_orderkey AS VARCHAR), 9, '0')), '[A-Z0-9]{10}') AS asin_ok
    FROM orders""")
def _(s):
    p = F.col("o_orderpriority")
    maybe = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise("")
    return s.table("orders").select(
        "o_orderkey", fn.after_first(p, "-").alias("tail"), fn.before_first(p, "-").alias("head"),
        fn.entity_key(F.col("o_orderstatus"), F.col("o_custkey").cast("string")).alias("key"),
        F.upper(fn.clean(F.concat(F.lit(" "), F.lower(p), F.lit(" ")))).alias("shouted"),
        fn.or_default(maybe, F.lit("none")).alias("chosen"), F.startswith(p, F.lit("1")).alias("urgent"),
        fn.label_of(F.lit("lag_roll_mean")).alias("label"), fn.any_hint(p, ["urgent", "high"]).alias("hinted"),
        F.concat(F.lit("B"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).rlike(fn.ASIN).alias("asin_ok"))


@query("scalar_dates", """
    SELECT o_orderkey, d AS iso, CAST(d - 1 AS DATE) AS ics_end, CAST(isodow(d) - 1 AS INTEGER) AS dow,
           CAST(month(d) AS INTEGER) AS month, CAST(dayofyear(d) AS INTEGER) AS doy, strftime(d, 'nightly-%Y%m%d') AS batch,
           strftime(d, '%m-%d') AS label, CAST(d + 30 AS DATE) AS later, CAST(d - DATE '1995-01-01' AS INTEGER) AS since
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(s):
    d = F.to_date("o_orderdate")
    return s.table("orders").select(
        "o_orderkey", fn.iso_date(d.cast("string")).alias("iso"),
        F.date_sub(fn.ics_date(F.date_format(d, "yyyyMMdd'T000000Z'")), 1).alias("ics_end"), fn.dow(d).alias("dow"),
        F.month(d).alias("month"), F.dayofyear(d).alias("doy"), fn.batch_id(d).alias("batch"),
        fn.month_day(d).alias("label"), F.date_add(d, 30).alias("later"),
        F.date_diff(d, F.lit("1995-01-01").cast("date")).alias("since"))


@query("scalar_math", """
    SELECT o_orderkey, greatest(o_totalprice - 200000, 0.0) AS low, least(greatest(o_totalprice / 1000 - 50, 0.0), 100.0) AS held,
           round(sqrt(abs(o_totalprice - 100000)), 4) AS root, round(sin(o_orderkey / 365.0), 4) AS wave,
           round(o_totalprice / 7, 2) AS cents, TRY_CAST(o_orderstatus AS DOUBLE) AS bad_number,
           CAST(o_custkey AS DOUBLE) AS good_number FROM orders""")
def _(s):
    price = F.col("o_totalprice")
    return s.table("orders").select(
        "o_orderkey", fn.clamp(price - 200000, 0).alias("low"), fn.clamp(price / 1000 - 50, 0, 100).alias("held"),
        F.round(F.sqrt(F.abs(price - 100000)), 4).alias("root"), F.round(F.sin(F.col("o_orderkey") / 365.0), 4).alias("wave"),
        F.round(price / 7, 2).alias("cents"), fn.number(F.col("o_orderstatus")).alias("bad_number"),
        fn.number(F.col("o_custkey").cast("string")).alias("good_number"))


@query("scalar_arrays", """
    SELECT vec_id, embedding[3] AS third, embedding[len(embedding)] AS last, CAST(len(embedding) AS INTEGER) AS size,
           list_sort(embedding[1:5])[1] AS least, embedding[10000] AS outside FROM embeddings""")
def _(s):
    rows = s.spark.read.schema("vec_id bigint, embedding array<float>, label int").parquet(f"{s.folder}/embeddings.parquet")
    return rows.select(
        "vec_id", F.get("embedding", F.lit(2)).alias("third"), fn.last_of(F.col("embedding")).alias("last"),
        F.size("embedding").alias("size"), F.get(F.sort_array(F.slice("embedding", 1, 5)), F.lit(0)).alias("least"),
        F.get("embedding", F.lit(9999)).alias("outside"))


@query("scalar_json", """
    SELECT event_id, k, concat('{"event":"', event_type, '","k":', k, '}') AS body, CAST(NULL AS VARCHAR) AS absent
    FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)""")
def _(s):
    k = F.from_json("props", "k int")["k"]
    return s.table("events").select(
        "event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("event"), k.alias("k"))).alias("body"),
        F.get_json_object("props", "$.missing").alias("absent"))


@query("mape_tone", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_quantity <= 15 THEN 'green'
           WHEN l_quantity <= 25 THEN 'amber' ELSE 'red' END AS tone FROM lineitem""")
def _(s):
    return s.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                      fn.mape_tone(F.col("l_quantity")).alias("tone"))
