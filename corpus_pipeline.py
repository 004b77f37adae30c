"""A corpus pipeline over the documents table: quality rules, near duplicates, benchmark passages, secrets, mixing.

Every stage takes all documents its predecessor kept and acts on its decisions. A stage's output is written as Parquet and
read again as the next one's input. A document is its id and text; rows that repeat both share one decision (they are kept if any of
them is, and lose the least list of lines), and the near-duplicate stage leaves one row an id, the least by all its columns.
Nulls, empty tables and further columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salesflow.llm.decontaminate import decontaminate
from salesflow.llm.mixture import mix
from salesflow.llm.near_dup import near_duplicates
from salesflow.llm.quality_rules import quality_rules, without_lines
from salesflow.llm.secret_scan import without_secrets
from salesflow.session import materialize

REMOVED = "_removed_lines"


def _decided(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """docs joined with decisions (doc_id, text_hash, ...), by id and text, null-safe."""
    a, b = docs.withColumn("_hash", F.xxhash64("text")).alias("a"), decisions.alias("b")
    return a.join(b, F.expr("a.doc_id <=> b.doc_id AND a._hash <=> b.text_hash"), how)


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits are cut out of the others."""
    kept = quality_rules(docs).filter("kept").groupBy("doc_id", "text_hash").agg(F.min(F.sort_array("removed")).alias(REMOVED))
    joined = _decided(docs, kept, "inner").select("a.*", f"b.{REMOVED}")
    return _resized(without_lines(joined.drop("_hash"), "text", REMOVED).drop(REMOVED)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; documents without id all stay."""
    # Of the kept texts of one id the one with the smallest hash stays.
    kept = near_duplicates(docs, text_hash=True).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    named = _decided(docs, kept, "left_semi").select(*docs.columns)
    # Rows that repeat an id and its text: the same one of them on every run.
    rest = [c for c in docs.columns if c != "doc_id"]
    one = named.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_row")).select("doc_id", *[F.col(f"_row.{c}").alias(c) for c in rest])
    return one.select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    gone = found.filter("contaminated").select("doc_id", "text_hash").distinct()
    return _decided(docs, gone, "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in them is replaced by a mark."""
    return _resized(without_secrets(docs)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and where: size, source_size, target, taken, draws."""
    return mix(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
]

# MinHash, hashed draws and the spans of secrets have no equal in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
