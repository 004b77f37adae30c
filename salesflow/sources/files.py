"""Uploaded files: sales and calendar CSV with a header per file, and ICS calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesflow.functions.scalars import after_first, ics_date
from salesflow.session import materialize
from salesflow.operators.validation import CALENDAR_REQUIRED, OPTIONAL, REQUIRED

NOT_TEXT = "File is not valid UTF-8 text"  # fixed value of the upload contract

def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file, empty ones too: upload_id (the file), its text, whether its bytes are UTF-8, and the width of its header.

    The width is one more than the commas of the first record, quoted ones included, so it is never too small.
    """
    whole = F.col("content").cast("string")
    first = F.regexp_extract("text", "^\\s*+((?:[^\"\\r\\n]++|\"(?:[^\"]++|\"\")*+\")*+)", 1)
    raw = spark.read.format("binaryFile").load(paths)
    # Readers pass over files without bytes; the list of files, which the reader holds anyway, still names them.
    same = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/")
    named = spark.createDataFrame([(f,) for f in raw.inputFiles()], "file string").select("file", same("file").alias("_f"))
    path = F.col("_metadata.file_path")
    read = raw.select(path.alias("upload_id"), F.is_valid_utf8(whole).alias("utf8"), F.make_valid_utf8(whole).alias("text"))
    unread = named.join(raw.select(same(path).alias("_f")), "_f", "left_anti").select(  # by name; no text is moved
        F.col("file").alias("upload_id"), F.lit(True).alias("utf8"), F.lit("").alias("text"))
    rows = read.unionByName(unread).withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "^\ufeff", ""))
    return rows.withColumn("width", (F.length(first) - F.length(F.replace(first, F.lit(","))) + 1).cast("int"))


def read_csv_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of CSV files: upload_id (the file), _id (position) and the values as text, as wide as the widest header.

    Headers may differ per file, so they are read as records and looked up by name. A quoted field may
    span lines, hence one task per file; positions ascend within it. They depend on how files are packed
    into tasks, so the records are parsed and numbered once and stored.
    """
    width = read_files(spark, paths).agg(F.max("width")).first()[0] or 1
    columns = [f"_c{i}" for i in range(width)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(
        paths, header=False, multiLine=True, mode="PERMISSIVE", escape='"', maxColumns=max(20480, 2 * width))
    return materialize(raw.select(
        F.col("_metadata.file_path").alias("upload_id"), F.monotonically_increasing_id().alias("_id"),
        F.array(*columns).alias("values")), "records")


def read_csv_headers(records: DataFrame, held: DataFrame) -> DataFrame:
    """One row per file of ``held``: position and names of its header, whether it is UTF-8 and whether it is empty.

    The first positions are written, so that their size is known and the records, which are wide, need no exchange to meet them.
    """
    firsts = materialize(records.groupBy("upload_id").agg(F.min("_id").alias("_id")), "firsts")
    name = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^\ufeff", "")))
    named = records.join(firsts, ["upload_id", "_id"]).select(
        "upload_id", F.col("_id").alias("_first"), F.transform("values", name).alias("header"))
    return held.select("upload_id", "utf8", (F.col("text") == "").alias("empty")).join(named, "upload_id", "left").select(
        "upload_id", "_first", F.coalesce("header", F.array().cast("array<string>")).alias("header"), "utf8", "empty")


def field(name: str) -> Column:
    """Value of a named column, empty when the file or the record lacks it."""
    at = F.array_position("header", F.lit(name))
    return F.when(at > 0, F.coalesce(F.get("values", (at - 1).cast("int")), F.lit(""))).otherwise(F.lit(""))


def file_problem(required: list[str], calendar: bool = False) -> Column:
    """What keeps a file from being read: text that is not UTF-8, no text (row 0), or missing columns (row 1)."""
    missing = F.array_except(F.array(*[F.lit(c) for c in required]), F.col("header"))
    message = F.lit("Required columns: label,start_date,end_date") if calendar else F.concat(
        F.lit("Missing required columns: "), F.array_join(missing, ", "))
    whole = lambda text: F.struct(F.lit(0).alias("row"), F.lit("file").alias("field"), F.lit(text).alias("message"))
    return F.when(~F.col("utf8"), whole(NOT_TEXT)).when(F.col("empty") & F.lit(not calendar), whole("Empty file")).when(F.size(missing) > 0, F.struct(
        F.lit(1).alias("row"), F.lit("header").alias("field"), message.alias("message")))


def read_named(spark: SparkSession, paths: str | list[str], names: list[str], required: list[str],
               calendar: bool = False) -> tuple[DataFrame, DataFrame]:
    """(data records of intact files with the named columns as text, errors of the other files)."""
    records = read_csv_records(spark, paths)
    heads = materialize(read_csv_headers(records, read_files(spark, paths)).withColumn("_problem", file_problem(required, calendar)), "heads")
    intact = heads.filter("_problem is null").select("upload_id", "_first", "header")
    rows = records.join(intact, "upload_id").filter(F.col("_id") > F.col("_first")).select(
        "upload_id", (F.col("_id") - F.col("_first") + 1).cast("int").alias("row_no"), *[field(n).alias(n) for n in names])
    return rows, heads.filter("_problem is not null").select("upload_id", "_problem.*")


def read_sales_csv(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to validate, file errors) of sales uploads."""
    return read_named(spark, paths, [*REQUIRED, *OPTIONAL], REQUIRED)


def read_calendar_csv(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return read_named(spark, paths, CALENDAR_REQUIRED, CALENDAR_REQUIRED, calendar=True)


def read_calendar(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to validate, file errors) of calendar uploads: ICS by name or content, else CSV."""
    held = read_files(spark, paths)
    ics = F.endswith(F.lower("upload_id"), F.lit(".ics")) | F.startswith(F.ltrim("text"), F.lit("BEGIN:VCALENDAR"))
    entries = split_ics(held.filter(F.col("utf8") & ics), text="text")
    garbled = held.filter(~F.col("utf8")).select(
        "upload_id", F.lit(0).alias("row"), F.lit("file").alias("field"), F.lit(NOT_TEXT).alias("message"))
    rows, errors = read_calendar_csv(spark, paths)
    plain = held.filter(F.col("utf8") & ~ics).select("upload_id")
    return (entries.unionByName(rows.join(plain, "upload_id", "left_semi")),
            garbled.unionByName(errors.join(plain, "upload_id", "left_semi")))


def split_ics(texts: DataFrame, key: str = "upload_id", text: str = "value") -> DataFrame:
    """Calendar entries of whole ICS texts as rows to validate; row_no is the line that ends the entry.

    Lines count once they are trimmed; only a whole line begins or ends an entry. The last summary, start and end of
    an entry hold; without a summary or a start it is left out. The end stamp is exclusive, so the last
    day is one day earlier; without an end it is the first day. A text is taken apart in its own row, so a task holds one file's
    lines at a time.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s++|\s++$", "")
    lines = texts.select(key, F.transform(F.split(F.col(text), r"\r\n|\r|\n", -1), strip).alias("_lines"))
    marked = lines.select(key, "_lines", F.filter(F.transform("_lines", lambda c, i: F.when(c == "END:VEVENT", i)), lambda i: i.isNotNull()).alias("_ends"))
    entry = lambda end, before: F.struct(
        (end + 1).alias("row_no"), F.slice("_lines", before + 2, end - before - 1).alias("_own"))
    entries = marked.select(key, F.inline(F.transform("_ends", lambda end, n: entry(end, F.coalesce(F.get("_ends", n - 1), F.lit(-1))))))
    begin = F.array_position("_own", "BEGIN:VEVENT").cast("int")
    inside = entries.filter(begin > 0).select(key, "row_no", F.slice("_own", begin + 1, F.size("_own")).alias("_own"))

    def last(name: str) -> Column:
        return strip(after_first(F.get(F.reverse(F.filter("_own", lambda c: F.startswith(c, F.lit(name)))), F.lit(0))))

    found = inside.select(key, "row_no", last("SUMMARY").alias("label"), last("DTSTART").alias("_start"), last("DTEND").alias("_end")).filter(
        "label <> '' and _start <> ''")
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    iso = lambda c: F.when(F.length(digits(c)) >= 8, F.regexp_replace(
        F.substring(digits(c), 1, 8), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise("")
    end = F.col("_end")
    day = F.when(F.length(digits(end)) >= 8, F.coalesce(F.date_sub(ics_date(end), 1).cast("string"), iso(end)))
    return found.select(key, "row_no", "label", iso(F.col("_start")).alias("start_date"), F.coalesce(day, F.lit("")).alias("end_date"))


def read_ics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return split_ics(read_files(spark, paths).filter("utf8"), text="text")
