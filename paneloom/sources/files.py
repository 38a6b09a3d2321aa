"""Readers and writers of files: CSV, JSON, Parquet, ORC, partitioned and resumable, with manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, between: tuple[str, str, str] | None = None, repeated_header: bool = False) -> DataFrame:
    """CSV with a given schema; columns and a range filter (column, from, to) reach the scan. ``repeated_header`` drops header lines
    that occur again among the rows of a text column."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    if repeated_header:
        first = df.columns[0]
        df = df.filter(F.col(first).isNull() | (F.col(first) != first))
    if between:
        c, a, b = between
        df = df.filter(F.col(c).between(a, b))
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, also compressed; NaN constants, malformed lines and lines with a key twice fail instead of passing as values."""
    text = spark.read.text(path)
    keys = F.json_object_keys("value")
    twice = F.size(keys) != F.size(F.array_distinct(keys))
    sound = F.when(F.coalesce(twice, F.lit(False)), F.raise_error(F.concat(F.lit("a key occurs twice: "), F.substring("value", 1, 200)))).otherwise(F.col("value"))
    read = F.from_json(sound, schema, {"mode": "FAILFAST", "allowNonNumericNumbers": "false"})
    return text.select(read.alias("_j")).select("_j.*")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Partitioned Parquet that can be resumed: a run replaces the partitions that it has rows for and no others."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table whose joins and windows on ``keys`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def manifest(df: DataFrame) -> DataFrame:
    """(``file``, ``rows``, ``digest``) of what was read: order within a file does not matter, content does."""
    cols = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in df.columns]
    own = df.select(F.input_file_name().alias("file"), F.xxhash64(*cols).alias("_h"))
    return own.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("_h").alias("digest"))


def append_facts(df: DataFrame, path: str, key: str) -> None:
    """Append-only facts: rows whose key is there already are not written again; of several new rows with a key the least counts,
    by all columns in order."""
    if exists(df.sparkSession, path):
        df = df.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    least = df.groupBy(key).agg(F.min(F.struct(*(f"`{c}`" for c in df.columns))).alias("_row"))
    least.select("_row.*").write.mode("append").parquet(path)
