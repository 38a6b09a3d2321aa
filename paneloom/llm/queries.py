"""Queries of the text problems 8 to 10, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .leakage import leaked, leaks_by_item, without_leaks, without_spans
from .subjects import composition, document_subjects
from .tokens import decoded, encoded, encoded_with_offsets


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(_table(spark, d, "documents"), "text", ["doc_id"])


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again; null comes back as the empty text."""
    return decoded(p8_ids(spark, d), "ids", ["doc_id"])


def p8_covered(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document and the code points that their offsets span."""
    t = encoded_with_offsets(_table(spark, d, "documents"), "text", ["doc_id"])
    return t.select("doc_id", F.coalesce(F.array_max("ends"), F.lit(0)).alias("code_points"))


def p9_leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaked(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaked(spark, d).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks_by_item(p9_leaked(spark, d)).select("item_id", "documents")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_leaks(_table(spark, d, "documents").select("doc_id", "lang", "source"), p9_leaked(spark, d))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with the leaked passages, and no more, cut out."""
    return without_spans(_table(spark, d, "documents").select("doc_id", "text"), p9_leaked(spark, d))


def p10_subjects(spark: SparkSession, d: str) -> DataFrame:
    subjects = [(r[0], r[1]) for r in _table(spark, d, "subject_areas").select("subject", "description").orderBy("subject").collect()]  # nine rows
    return document_subjects(_table(spark, d, "documents"), _table(spark, d, "doc_labels"), subjects)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return composition(p10_subjects(spark, d), _table(spark, d, "documents"), ["lang", "source"])


QUERIES = {f.__name__: f for f in (p8_ids, p8_decoded, p8_covered, p9_found, p9_items, p9_clean, p9_spans, p10_found, p10_composition)}
ORACLE = {
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p8_covered": "select doc_id, cast(coalesce(length(text), 0) as integer) as code_points from documents",
}
