"""Structured Streaming: windows with watermarks, idempotent ledgers, keyed interval maps and daily decisions.

Every function takes a streaming DataFrame; ``run_once`` drives one through all that is there and returns the sink as a table.
Sinks and checkpoints lie in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import IntervalMap
from ..session import exists, shared_folder


def stream_table(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet folder or file as a stream, with the schema of what lies there; times without zone become instants in the
    session's zone, which watermarks need. ``files_a_batch`` bounds a micro-batch."""
    schema = spark.read.parquet(path).schema
    if files_a_batch:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
        return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})
    # a pattern, because a source may be one file and a plain path must be a folder
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_once(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Writes all that is available, in micro-batches, and returns the written table. In complete and update mode each batch
    writes a folder of its own, named by ``_batch``. A run with the ``base`` of an earlier one takes up where that ended."""
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/paneloom/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
    if mode == "append":
        query = writer.format("parquet").start(f"{base}/out")
    else:
        def save(batch: DataFrame, number: int) -> None:  # the same number overwrites its own folder: idempotent
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/number={number}")

        query = writer.foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def tumbling(events: DataFrame, at: str, size: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Sums and counts of fixed windows; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sliding(events: DataFrame, at: str, size: str, slide: str, late: str, keys: list[str], value: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, at: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def first_only(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Each key once, however often it is delivered within ``late``."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def interval_maps(intervals: DataFrame, entity: str, first: str, last: str) -> DataFrame:
    """Covered periods by entity, updated as intervals arrive: the ordered disjoint map is the key's state. Rows (entity,
    ``first``, ``last``, ``version``) give the whole map of each entity that a batch touched; later versions replace it."""
    kind = dict(intervals.dtypes)[entity]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        firsts, lasts, version = state.get if state.exists else ([], [], 0)
        own = IntervalMap(list(firsts), list(lasts))
        for batch in batches:
            for a, b in zip(batch[first].tolist(), batch[last].tolist()):
                own.insert(int(a), int(b))
        state.update((own.first, own.last, version + 1))
        yield pd.DataFrame({entity: [key[0]] * len(own.first), "first": own.first, "last": own.last, "version": version + 1})

    rows = intervals.filter(F.col(entity).isNotNull() & (F.col(first) <= F.col(last))).select(entity, F.col(first).cast("long").alias(first), F.col(last).cast("long").alias(last))
    return rows.groupBy(entity).applyInPandasWithState(
        update, f"`{entity}` {kind}, first long, last long, version int", "firsts array<long>, lasts array<long>, version int", "update", GroupStateTimeout.NoTimeout
    )


def daily_decisions(stream: DataFrame, at: str, decide: Callable[[DataFrame], DataFrame], sink: str, late_days: int = 1, finish: bool = False) -> DataFrame:
    """Decides each day once, from all its rows, however they spread over micro-batches, and returns the decisions.

    Rows are kept by batch and ``day`` (``yyyyMMdd`` of ``at``) beside the sink. A day is decided by the first batch after which the
    latest row seen is more than ``late_days`` days past it; ``decide`` gets the rows of such days with their ``day`` and returns
    rows with a ``day``. Later rows of a decided day change nothing. A batch that comes again replaces what it wrote.
    ``finish`` decides the days that are still open when the stream ends. Rows without a time belong to no day.
    """
    spark, rows = stream.sparkSession, f"{sink}-rows"

    def settle(number: int, everything: bool) -> None:
        if not exists(spark, rows):
            return
        kept = spark.read.parquet(rows).withColumn("day", F.col("day").cast("string"))
        last = kept.agg(F.max("day")).first()[0]
        if last is None:
            return
        if exists(spark, sink):
            kept = kept.join(spark.read.parquet(sink).filter(F.col("batch") != number).select(F.col("day").cast("string").alias("day")).distinct(), "day", "left_anti")
        if not everything:
            kept = kept.filter(F.datediff(F.to_date(F.lit(last), "yyyyMMdd"), F.to_date("day", "yyyyMMdd")) > late_days)
        decide(kept.drop("batch")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    def save(batch: DataFrame, number: int) -> None:
        dated = batch.withColumn("day", F.date_format(at, "yyyyMMdd")).filter(F.col("day").isNotNull())
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{rows}/batch={number}")
        settle(number, False)

    stream.writeStream.foreachBatch(save).trigger(availableNow=True).option("checkpointLocation", f"{sink}-checkpoint").start().awaitTermination()
    if finish:
        settle(-1, True)
    return spark.read.parquet(sink).drop("batch")
