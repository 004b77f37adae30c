"""Sales, signal, upload and serving tables derived from the star-schema test tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesflow.functions.scalars import batch_id
from salesflow.operators import silver
from salesflow.operators.keyed import latest
from salesflow.session import materialize

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Order that makes the latest sales record unique.
SALES_ORDER = ["ingested_at", "l_orderkey", "l_linenumber", "quantity", "revenue"]
FIRST_DAY = "1995-01-02"
DAYS = 2499

SOURCE_OF_EVENT = {"view": "weather", "click": "trends", "signup": "holidays", "purchase": "events", "error": "macro"}


def region_user(c: Column) -> Column:
    return F.concat(F.lit("r"), c.cast("string"))


class Sample:
    """The tables of one folder, read with declared schemas and only when used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._stored: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        path = os.path.join(self.folder, f"{name}.parquet")
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def stored(self, name: str, build) -> DataFrame:
        """A derived table written once per query, for plans that read it several times."""
        if name not in self._stored:
            self._stored[name] = materialize(build(), name)
        return self._stored[name]

    def as_of(self) -> Column:
        """Last day with sales, as a scalar subquery over one column."""
        return self.table("lineitem").agg(F.max(F.to_date("l_shipdate"))).scalar()

    def tenants(self) -> DataFrame:
        """Supplier keys with the tenant of their region."""
        return self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        ).select("s_suppkey", region_user(F.col("n_regionkey")).alias("user_id"))

    def sales_raw(self) -> DataFrame:
        lines, orders, part, tenants = self.table("lineitem"), self.table("orders"), self.table("part"), self.tenants()
        return (
            lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .join(part, lines.l_partkey == part.p_partkey)
            .join(tenants, lines.l_suppkey == tenants.s_suppkey)
            .select(
                "user_id", F.col("p_brand").alias("sku"), F.to_date("l_shipdate").alias("date"),
                F.col("l_quantity").alias("quantity"),
                (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                F.col("p_retailprice").alias("price"), (F.col("p_type") == "PROMO").alias("promo_flag"),
                F.col("o_orderdate").alias("ingested_at"), "l_orderkey", "l_linenumber",
                F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
                F.col("p_partkey").alias("part_key"),
            )
        )

    def sales_days(self) -> DataFrame:
        """Every series and day of ``sales_raw`` with the line that was ingested last and the smallest part key, on storage.

        Order lines meet orders and parts with keys and days only; the tenants are written first, so their size is known and the
        lines need no exchange for them.
        """
        def build() -> DataFrame:
            tenants = self.stored("tenants", self.tenants)
            orders = self.table("orders").select("o_orderkey", F.col("o_orderdate").alias("ingested_at"))
            part = self.table("part").select("p_partkey", F.col("p_brand").alias("sku"))
            lines = self.table("lineitem").select(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date"))
            rows = lines.join(tenants, lines.l_suppkey == tenants.s_suppkey).drop("l_suppkey", "s_suppkey").join(
                orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
            days = rows.groupBy("user_id", "sku", "date").agg(
                F.max(F.struct("ingested_at", "l_orderkey", "l_linenumber")).alias("_n"), F.min("p_partkey").alias("part_key"))
            return days.select("user_id", "sku", "date", "_n.*", "part_key")

        return self.stored("days", build)

    def sales_newest(self) -> DataFrame:
        """The rows of ``sales_raw`` that are newest for their series and day by ingest time, order and line.

        Lines are looked up by the keys of ``sales_days``, so quantities and prices of all others are never moved. Copies of a line
        are all kept; the rest of SALES_ORDER decides between them.
        """
        part, lines, own = self.table("part"), self.table("lineitem"), self.tenants().withColumnRenamed("user_id", "_user")
        newest = self.sales_days().select(
            "user_id", "sku", "date", "ingested_at", F.col("l_orderkey").alias("_key"), F.col("l_linenumber").alias("_line"))
        day = F.to_date("l_shipdate")
        found = lines.join(newest, (F.col("l_orderkey") == F.col("_key")) & F.col("l_linenumber").eqNullSafe(F.col("_line"))
                           & day.eqNullSafe(F.col("date")))
        found = found.join(part, (F.col("l_partkey") == F.col("p_partkey")) & F.col("p_brand").eqNullSafe(F.col("sku")))
        found = found.join(own, (F.col("l_suppkey") == F.col("s_suppkey")) & F.col("_user").eqNullSafe(F.col("user_id")))
        return found.select(
            "user_id", "sku", "date", F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.col("p_retailprice").alias("price"),
            (F.col("p_type") == "PROMO").alias("promo_flag"), "ingested_at", "l_orderkey", "l_linenumber")

    def silver_sales(self) -> DataFrame:
        return self.stored("silver", lambda: silver.to_silver(self.sales_newest(), SALES_ORDER))

    def signals(self) -> DataFrame:
        """Feed rows with every typed field the sources need; NULL where a source has none."""
        e = self.table("events")
        k = F.get_json_object("props", "$.k").cast("int")
        return e.select(
            F.col("event_id").alias("seq"),
            F.element_at(F.create_map(*[F.lit(x) for pair in SOURCE_OF_EVENT.items() for x in pair]),
                         F.col("event_type")).alias("source"),
            F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("event_id") % DAYS).cast("int")).alias("date"),
            F.col("ts").alias("ingested_at"),
            region_user(F.col("user_id") % 5).alias("user_id"),
            F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("country_code"),
            k.alias("k"), "value",
        )

    def weather_raw(self) -> DataFrame:
        return self.signals().filter("source = 'weather'").select(
            "user_id", "date", F.col("value").alias("temp_avg"), (F.col("k") % 10).cast("double").alias("precip_mm"),
            "ingested_at", "seq")

    def trends_raw(self) -> DataFrame:
        return self.signals().filter("source = 'trends'").select(
            "user_id", "date", F.least(F.col("k"), F.lit(100)).cast("double").alias("interest"), "ingested_at", "seq")

    def holidays(self) -> DataFrame:
        return self.signals().filter("source = 'holidays'").select("country_code", "date").distinct()

    def events_raw(self) -> DataFrame:
        kind = F.col("k") % 5
        return self.signals().filter("source = 'events'").select(
            "user_id", "date", F.concat(F.lit("e"), F.col("seq").cast("string")).alias("event_id"),
            F.when(kind == 0, "").when(kind == 1, "Music").when(kind == 2, "Sports").when(kind == 3, "Arts")
            .alias("category"),
            (F.col("k") >= 80).alias("large_venue"), "ingested_at", "seq")

    def macro_raw(self) -> DataFrame:
        return self.signals().filter("source = 'macro'").select(
            F.concat(F.lit("S"), (F.col("k") % 4).cast("string")).alias("series"), "date", "value",
            "ingested_at", "seq")

    def weather(self) -> DataFrame:
        return silver.latest_per_day(self.weather_raw(), ["user_id"]).select("user_id", "date", "temp_avg", "precip_mm")

    def trends(self) -> DataFrame:
        return silver.latest_per_day(self.trends_raw(), ["user_id"]).select("user_id", "date", "interest")

    def events_daily(self) -> DataFrame:
        return silver.events_to_daily(self.events_raw())

    def macro(self) -> DataFrame:
        return silver.latest_per_day(self.macro_raw(), ["series"]).select("series", "date", "value")

    def profiles(self) -> DataFrame:
        """Regions as tenants; the last one has no location yet."""
        r = self.table("region")
        located = F.col("r_regionkey") < 4
        return r.select(
            region_user(F.col("r_regionkey")).alias("id"),
            F.concat(F.lit("C"), (F.col("r_regionkey") % 3).cast("string")).alias("country_code"),
            F.col("r_name").alias("city"),
            F.when(located, F.col("r_regionkey") * 10.5).alias("latitude"),
            F.when(located, F.col("r_regionkey") * -20.25).alias("longitude"),
            F.lit("UTC").alias("timezone"), F.lit("USD").alias("currency"),
        )

    def calendar_events(self) -> DataFrame:
        start = F.date_add(F.lit("1995-01-15").cast("date"), F.col("n_nationkey") * 90)
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"), region_user(F.col("n_regionkey")).alias("user_id"),
            F.col("n_name").alias("label"), start.alias("start_date"),
            F.date_add(start, 6 + F.col("n_nationkey") % 10).alias("end_date"),
        )

    def spans(self, extra_days: int = 0) -> DataFrame:
        """First to last sales day for every tenant, plus the days of the horizon; reads one column."""
        days = self.table("lineitem").agg(F.struct(
            F.min(F.to_date("l_shipdate")).alias("low"), F.max(F.to_date("l_shipdate")).alias("high"))).scalar()
        return self.profiles().withColumn("_d", days).select(
            F.col("id").alias("user_id"), F.col("_d.low").alias("start_date"),
            F.date_add("_d.high", extra_days).alias("end_date"))

    def products(self) -> DataFrame:
        """Series with the name and category of their smallest part key; a part key that comes twice is read by its brand."""
        part = self.table("part").select("p_partkey", "p_brand", F.col("p_name").alias("product_name"), F.col("p_type").alias("category"))
        series = self.sales_days().groupBy("user_id", "sku").agg(
            F.min("part_key").alias("part_key"), F.count("date").cast("int").alias("sales_days"), F.max("date").alias("last_sale_date"))
        named = part.join(series, (F.col("p_partkey") == F.col("part_key")) & F.col("p_brand").eqNullSafe(F.col("sku")))
        return named.groupBy("user_id", "sku").agg(
            F.min("product_name").alias("product_name"), F.min("category").alias("category"),
            F.max("sales_days").alias("sales_days"), F.max("last_sale_date").alias("last_sale_date"))

    def upload_rows(self) -> DataFrame:
        """Order lines as text rows of an uploaded file, one file per order, with faults in some rows."""
        lines, orders = self.table("lineitem"), self.table("orders")
        part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type")
        line, status, returned = F.col("l_linenumber"), F.col("l_linestatus"), F.col("l_returnflag")
        day = F.to_date("l_shipdate")
        quantity = F.col("l_quantity").cast("int").cast("string")
        return (
            lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .join(part, lines.l_partkey == part.p_partkey)
            .select(
                F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("upload_id"),
                region_user(F.col("o_custkey") % 5).alias("user_id"),
                (line + 1).alias("row_no"),
                F.when((line == 7) & (returned == "R"), F.date_format(day, "MM/dd/yyyy"))
                .otherwise(F.date_format(day, "yyyy-MM-dd")).alias("date"),
                F.when(F.col("l_partkey") % 97 == 0, " ").otherwise(F.col("p_brand")).alias("sku"),
                F.when(F.col("l_partkey") % 10 == 0, "").otherwise(F.col("p_name")).alias("product_name"),
                F.when(line == 6, F.concat(F.lit("-"), quantity)).otherwise(quantity).alias("quantity"),
                F.when((line == 5) & (status == "N"), "oops").when(F.col("l_partkey") % 13 == 0, "")
                .otherwise("10.5").alias("revenue"),
                F.when(F.col("l_partkey") % 89 == 0, "-1").when(F.col("l_partkey") % 2 == 0, " 4.25 ")
                .otherwise("").alias("price"),
                F.when((line == 4) & (returned == "A"), "maybe").when(F.col("p_type") == "PROMO", "TRUE")
                .otherwise("").alias("promo_flag"),
                F.col("l_partkey").alias("seq"),
            )
        )

    def sales_daily(self) -> DataFrame:
        """Serving table of sales, one row per series and day."""
        return self.silver_sales().drop("gap_flag").withColumn("source", F.lit("csv"))

    def forecasts(self) -> DataFrame:
        """Baseline forecasts of two runs; the older run is one unit higher."""
        from salesflow.plans import baseline

        last = baseline.seasonal_naive(self.silver_sales(), F.date_add(self.as_of(), 1), 30)
        day = self.as_of()
        return last.select(
            "user_id", "sku", "date", "yhat", "yhat_lower", "yhat_upper", F.explode(F.array(F.lit(0), F.lit(8))).alias("back"),
        ).withColumn("_run_day", F.date_sub(day, F.col("back"))).select(
            "user_id", "sku", F.date_sub("date", F.col("back")).alias("forecast_date"),
            batch_id(F.col("_run_day")).alias("model_run_id"),
            F.when(F.pmod(F.ascii(F.substring("sku", -1, 1)), F.lit(2)) == 0, "seasonal-naive")
            .otherwise("boosted:1").alias("model_version"),
            *[F.round(F.col(c) + F.when(F.col("back") == 8, 1.0).otherwise(0.0), 2).alias(c)
              for c in ("yhat", "yhat_lower", "yhat_upper")],
            F.lit(12.5).alias("mape_backtest"),
            F.col("_run_day").cast("timestamp_ntz").alias("generated_at"),
        )

    def health_reports(self) -> DataFrame:
        """One health report per feed event: the feed failed where k is below ten."""
        s = self.signals()
        failed = F.col("k") < 10
        return s.select(
            F.col("source").alias("signal"),
            F.when(failed & (F.col("k") < 5), "degraded").when(failed, "stale").otherwise("live").alias("status"),
            F.when(~failed, F.col("ingested_at")).alias("last_success_at"),
            F.when(failed, F.concat(F.lit("error "), F.col("k").cast("string"))).alias("last_error"),
            F.col("ingested_at").alias("reported_at"), "seq",
        )

    def signal_status(self) -> DataFrame:
        return latest(self.health_reports(), ["signal"], ["reported_at", "seq"]).drop("seq")

    def settings(self) -> DataFrame:
        """Toggles some tenants have set: those of their nations, alternating."""
        from salesflow.schemas import SIGNALS

        names = F.array(*[F.lit(s) for s in SIGNALS])
        return self.table("nation").groupBy(
            region_user(F.col("n_regionkey")).alias("user_id"),
            F.element_at(names, F.col("n_nationkey") % 4 + 1).alias("signal"),
        ).agg((F.max("n_nationkey") % 2 == 0).alias("enabled"))

    def asins(self) -> DataFrame:
        """Supplier codes as tracked marketplace ids, created in key order."""
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        code = F.lpad(F.col("s_suppkey").cast("string"), 8, "0")
        return s.select(
            region_user(F.col("n_regionkey")).alias("user_id"),
            F.when(F.col("s_suppkey") % 11 == 0, F.concat(F.lit("b-"), code))
            .otherwise(F.concat(F.lit("B0"), code)).alias("asin"),
            F.col("s_suppkey").alias("created_at"),
        )
