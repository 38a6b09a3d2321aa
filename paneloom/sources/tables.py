"""Readers of the market tables: narrow columns, one notation for codes and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day_number, instrument_code, latest


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def coded(df: DataFrame, *dates: str) -> DataFrame:
    """``ts_code`` in one notation; each date column as a day number, in place."""
    return df.withColumns({"ts_code": instrument_code("ts_code")} | {d: day_number(d) for d in dates})


def daily_rows(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The row that counts of each (ts_code, day): the one ingested last. ``day`` is a day number; rows without a date have none."""
    raw = table(spark, folder, "daily").select("ts_code", "trade_date", "ingested_at", *columns)
    keyed = coded(raw, "trade_date").withColumnRenamed("trade_date", "day")
    # Combined before the shuffle, so that a much repeated key costs nothing; a maximum for each column (rows that share
    # the latest time are equal) keeps to hash aggregation, which a struct of them would not.
    return keyed.filter(F.col("day").isNotNull()).groupBy("ts_code", "day").agg(*(latest(c, "ingested_at").alias(c) for c in columns))


def distinct_rows(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One row for each (ts_code, day) of a table whose repeated rows are equal; of unequal ones the greatest values."""
    raw = coded(table(spark, folder, name).select("ts_code", "trade_date", *columns), "trade_date").withColumnRenamed("trade_date", "day")
    return raw.filter(F.col("day").isNotNull()).groupBy("ts_code", "day").agg(*(F.max(c).alias(c) for c in columns))
