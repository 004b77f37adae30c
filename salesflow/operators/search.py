"""Search in names by an index of trigrams.

The text is a pattern, as in ILIKE: % stands for any characters, _ for one, a backslash makes the next one plain. Names that hold all
trigrams of the pattern's plain pieces are looked up and then matched; a pattern without a plain piece of three characters is matched
against all names of the tenant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salesflow.schemas import SERIES

GRAM = 3
BUCKETS = 32
POSTINGS = "gram string, user_id string, sku string, bucket int"


def matches(name: str, text: str) -> Column:
    """Whether the name contains the pattern, in any case."""
    return F.col(name).ilike(f"%{text}%")


def plain_pieces(text: str) -> list[str]:
    """Pieces of a pattern between its wildcards, in lower case."""
    pieces, piece, escaped = [], "", False
    for c in text.lower():
        if escaped or c not in "%_\\":
            piece, escaped = piece + c, False
        elif c == "\\":
            escaped = True
        else:
            pieces.append(piece)
            piece = ""
    return [p for p in [*pieces, piece] if p]


def pattern_grams(text: str) -> list[str]:
    """Trigrams that every match holds."""
    return sorted({p[i:i + GRAM] for p in plain_pieces(text) for i in range(len(p) - GRAM + 1)})


def postings(names: DataFrame, name: str = "product_name") -> DataFrame:
    """One row per trigram of each name (user_id, sku, name)."""
    low = F.lower(name)
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    rows = names.filter(F.length(low) >= GRAM).select(F.explode(F.array_distinct(grams)).alias("gram"), *SERIES)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))


def index_names(names: DataFrame, path: str, name: str = "product_name") -> None:
    """Enter new or changed names. What a changed name no longer holds may stay: a match is always decided on the name itself.

    Entering a name again changes no result; writing the index of all names to a new path makes it small again.
    """
    ordered = postings(names, name).repartition("bucket").sortWithinPartitions("bucket", "gram", *SERIES)
    ordered.write.mode("append").partitionBy("bucket").parquet(path)


def search_names(spark: SparkSession, path: str, names: DataFrame, text: str, tenant: str | None = None, name: str = "product_name") -> DataFrame:
    """Rows of ``names`` (of one tenant or all) whose name contains the pattern."""
    if tenant is not None:
        names = names.filter(F.col("user_id") == tenant)
    grams = pattern_grams(text)
    if not grams:
        return names.filter(matches(name, text))
    asked = spark.createDataFrame([(g,) for g in grams], "gram string")
    buckets = sorted({r[0] for r in asked.select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).collect()})
    held = spark.read.schema(POSTINGS).parquet(path).filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    if tenant is not None:
        held = held.filter(F.col("user_id") == tenant)
    found = held.groupBy(*SERIES).agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
    return names.join(found.select(*SERIES), SERIES, "left_semi").filter(matches(name, text))
