"""Validation of uploaded sales and calendar rows, profiles and marketplace ids.

Rules are ordered and a rejected row reports its first broken rule only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesflow.functions.scalars import ASIN, clean, flag, iso_date, number
from salesflow.operators.keyed import missing_columns, top_n

# Columns, limits and messages (below) of the upload contract.
REQUIRED = ["date", "sku", "product_name", "quantity", "revenue"]
OPTIONAL = ["price", "promo_flag"]
CALENDAR_REQUIRED = ["label", "start_date", "end_date"]
MAX_ROWS = 100_000
MAX_SKUS = 500
ASIN_CAP = 10


def error(row: Column, field: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(row.cast("int").alias("row"), F.lit(field).alias("field"), message.alias("message"))


def number_error(name: str, required: bool) -> Column:
    """Message for a text that is no number, or a negative one; NULL when fine."""
    text, value = F.col(name), number(F.col(name))
    bad = F.concat(F.lit(f"{name} could not convert string to float: '"), text, F.lit("'"))
    broken = F.when(value.isNull(), bad).when(value < 0, f"{name} must be >= 0")
    return broken if required else F.when(text != "", broken)


def normalised_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def header_errors(df: DataFrame, required: list[str] = REQUIRED, calendar: bool = False) -> DataFrame:
    """One error row when the file lacks required columns, else none."""
    missing = missing_columns(df, required)
    message = "Required columns: label,start_date,end_date" if calendar else \
        f"Missing required columns: {', '.join(missing)}"
    rows = [(1, "header", message)] if missing else []
    return df.sparkSession.createDataFrame(rows, "row int, field string, message string")


def row_cap(rows: DataFrame, max_rows: int, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows within the cap, and one file error for each upload that goes beyond it.

    The cap is a contract of the upload: rows behind it are reported, not loaded.
    """
    keys = keys or ["upload_id"]
    within = rows.filter(F.col("row_no") - 1 <= max_rows)
    beyond = rows.filter(F.col("row_no") - 1 > max_rows).groupBy(*keys).agg(F.min("row_no").alias("row_no"))
    return within, beyond.select(
        *keys, F.col("row_no").cast("int").alias("row"), F.lit("file").alias("field"),
        F.lit(f"Row limit exceeded ({max_rows})").alias("message"))


def sku_cap(rows: DataFrame, max_skus: int) -> DataFrame:
    """Accepted SKUs of each upload: the first ``max_skus`` by first appearance, rejected rows included."""
    seen = rows.filter(F.col("sku") != "").groupBy("upload_id", "sku").agg(F.min("row_no").alias("first_row"))
    return top_n(seen, ["upload_id"], [F.col("first_row"), F.col("sku")], max_skus)


def cleaned_sales(rows: DataFrame) -> DataFrame:
    """Upload rows with all contract columns, trimmed."""
    for name in OPTIONAL:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(""))
    return rows.withColumns({c: clean(F.col(c)) for c in [*REQUIRED, *OPTIONAL]})


def row_limit_error(row: Column, max_rows: int) -> Column:
    return error(row, "file", f"Row limit exceeded ({max_rows})")


def with_errors(rows: DataFrame, max_skus: int | None) -> DataFrame:
    """Cleaned rows with ``error``, the first broken rule of each; ``_allowed`` is NULL where the SKU is beyond the limit, and goes."""
    at = F.col("row_no")
    quantity, revenue = number_error("quantity", True), number_error("revenue", False)
    price = number_error("price", False)
    problem = F.coalesce(
        F.when(F.col("sku") == "", error(at, "sku", "sku is required")),
        F.when(F.col("_allowed").isNull(), error(at, "sku", f"SKU limit exceeded ({max_skus} per file)")),
        F.when(iso_date(F.col("date")).isNull(), error(at, "date", "date must be ISO YYYY-MM-DD")),
        F.when(quantity.isNotNull(), error(at, "quantity", quantity)),
        F.when(revenue.isNotNull(), error(at, "revenue", revenue)),
        F.when(price.isNotNull(), error(at, "price", price)),
        F.when(flag(F.col("promo_flag")).isNull(), error(at, "promo_flag", "must be true/false/0/1")),
    )
    return rows.withColumn("error", problem).drop("_allowed")


def validate_sales(rows: DataFrame, max_rows: int | None = None, max_skus: int | None = None) -> DataFrame:
    """Text rows with ``error`` (NULL = valid) and typed values.

    ``rows`` carry upload_id, row_no (header = 1) and the contract columns as text. The limits of an upload
    (MAX_ROWS, MAX_SKUS) hold where they are given. The rows beyond the row limit are
    one row with the limit's error, whose other columns are NULL.
    """
    rows = cleaned_sales(rows)
    beyond = None
    if max_rows is not None:
        rows, beyond = row_cap(rows, max_rows)
    if max_skus is None:
        rows = rows.withColumn("_allowed", F.lit(True))
    else:
        allowed = sku_cap(rows, max_skus).select("upload_id", "sku", F.lit(True).alias("_allowed"))
        rows = rows.join(allowed, ["upload_id", "sku"], "left")
    rows = with_errors(rows, max_skus)
    if beyond is None:
        return rows
    return rows.unionByName(beyond.select(
        "upload_id", F.col("row").cast(rows.schema["row_no"].dataType).alias("row_no"), F.struct("row", "field", "message").alias("error")), True)


def valid_sales(validated: DataFrame) -> DataFrame:
    """Typed rows without an error; a blank name falls back to the SKU."""
    keep = [c for c in validated.columns if c not in [*REQUIRED, *OPTIONAL, "error"]]
    return validated.filter("error is null").select(
        *keep, "sku", iso_date(F.col("date")).alias("date"),
        F.coalesce(F.nullif(F.col("product_name"), F.lit("")), "sku").alias("product_name"),
        *[number(F.col(c)).alias(c) for c in ("quantity", "revenue", "price")],
        flag(F.col("promo_flag")).alias("promo_flag"))


def outcome(validated: DataFrame) -> DataFrame:
    """One row per record: the error, or the typed values where there is none."""
    good = F.col("error").isNull()
    keep = [c for c in validated.columns if c not in [*REQUIRED, *OPTIONAL, "error"]]
    typed = {
        "date": iso_date(F.col("date")), **{c: number(F.col(c)) for c in ("quantity", "revenue", "price")},
        "promo_flag": flag(F.col("promo_flag"))}
    return validated.select(*keep, "sku", "error.field", "error.message",
                            *[F.when(good, c).alias(name) for name, c in typed.items()])


def error_rows(validated: DataFrame, file_errors: DataFrame | None = None) -> DataFrame:
    """One row per error: upload, row, field, message."""
    found = validated.filter("error is not null").select("upload_id", "error.row", "error.field", "error.message")
    return found if file_errors is None else found.unionByName(file_errors)


def product_names(validated: DataFrame) -> DataFrame:
    """First valid name of each SKU."""
    named = valid_sales(validated)
    return named.groupBy("user_id", "sku").agg(F.min(F.struct("upload_id", "row_no", "product_name")).alias("_f")).select(
        "user_id", "sku", "_f.product_name")


def product_stats(sales: DataFrame) -> DataFrame:
    """Days with sales and last day of each series, from a table unique per series and day."""
    return sales.groupBy("user_id", "sku").agg(
        F.count(F.lit(1)).cast("int").alias("sales_days"), F.max("date").alias("last_sale_date"))


def upload_status(validated: DataFrame, file_errors: DataFrame | None = None) -> DataFrame:
    """Loaded when at least one row was valid; counts of valid and rejected rows.

    With ``file_errors`` (upload_id, row, field, message) files that were refused as a whole are uploads too.
    """
    counts = validated.select("upload_id", F.col("error").isNull().alias("good"))
    if file_errors is not None:
        counts = counts.unionByName(file_errors.select("upload_id", F.lit(False).alias("good")))
    ok = F.count_if("good")
    return counts.groupBy("upload_id").agg(
        F.when(ok > 0, "loaded").otherwise("failed").alias("status"), ok.cast("int").alias("row_count"),
        F.count_if(~F.col("good")).cast("int").alias("rejected"))


def error_report(errors: DataFrame) -> DataFrame:
    """Errors of an upload as one array, at most one for each of its rows."""
    return errors.groupBy("upload_id").agg(
        F.array_sort(F.collect_list(F.struct("row", "field", "message"))).alias("error_report"))


def validate_calendar(rows: DataFrame) -> DataFrame:
    """``rows``: row_no, label, start_date, end_date as text. Adds ``error``; types the dates of valid rows."""
    rows = rows.withColumns({c: clean(F.col(c)) for c in CALENDAR_REQUIRED})
    start, end = iso_date(F.col("start_date")), iso_date(F.col("end_date"))
    last = F.when(F.col("end_date") == "", start).otherwise(end)
    at = F.col("row_no")
    problem = F.coalesce(
        F.when(F.col("label") == "", error(at, "label", "label is required")),
        F.when(start.isNull(), error(at, "start_date", "must be ISO YYYY-MM-DD")),
        F.when(last.isNull(), error(at, "end_date", "must be ISO YYYY-MM-DD")),
        F.when(last < start, error(at, "end_date", "end_date must be >= start_date")),
    )
    # One select: each column below reads the text columns of the input.
    keep = [c for c in rows.columns if c not in CALENDAR_REQUIRED]
    return rows.select(*keep, "label", start.alias("start_date"), last.alias("end_date"), problem.alias("error"))


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """Upper-cased codes and the list of fields out of range."""
    checks = [
        ("country_code", F.length("country_code") == 2),
        ("latitude", F.col("latitude").between(-90, 90)),
        ("longitude", F.col("longitude").between(-180, 180)),
        ("currency", F.length("currency") == 3),
    ]
    optional = {"latitude", "longitude"}
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(name in optional)), name) for name, ok in checks]))
    return profiles.withColumns({
        "country_code": F.upper("country_code"), "currency": F.upper("currency"), "invalid": failed})


def validate_asins(proposed: DataFrame, existing: DataFrame, order: str = "created_at", cap: int = ASIN_CAP) -> DataFrame:
    """Outcome of adding ids one by one in ``order``: accepted, invalid, duplicate or cap_reached.

    Only the first free slots of a tenant are ranked. Every other row is judged by the moment its
    tenant became full, so no tenant is ordered as a whole.
    """
    keys = ["user_id", "asin"]
    well_formed = F.col("asin").rlike(ASIN)
    have = existing.groupBy("user_id").agg(F.count(F.lit(1)).alias("_have"))
    fresh = proposed.filter(well_formed).groupBy(*keys).agg(F.min(order).alias(order)).join(
        existing.select(*keys).distinct(), keys, "left_anti")
    ranked = top_n(fresh, ["user_id"], [F.col(order), F.col("asin")], cap, position="_rank").join(have, "user_id", "left")
    accepted = ranked.filter(F.col("_rank") + F.coalesce("_have", F.lit(0)) <= cap)
    added = accepted.groupBy("user_id").agg(F.count(F.lit(1)).alias("_added"), F.max(order).alias("_last"))
    rows = (
        proposed.join(accepted.select(*keys, order, F.lit(True).alias("_ok")), [*keys, order], "left")
        .join(have, "user_id", "left").join(added, "user_id", "left")
    )
    total = F.coalesce("_have", F.lit(0)) + F.coalesce("_added", F.lit(0))
    full = (total >= cap) & (F.col("_last").isNull() | (F.col(order) > F.col("_last")))
    status = (
        F.when(~well_formed, "invalid").when(F.col("_ok"), "accepted").when(full, "cap_reached").otherwise("duplicate"))
    return rows.withColumn("outcome", status).drop("_ok", "_have", "_added", "_last")
