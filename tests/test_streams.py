"""Streams of several micro-batches: late rows, state across batches and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paneloom.session import shared_folder
from paneloom.streaming import streams as T


def at(day, hour):
    return dt.datetime(2024, 3, day, hour)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(folder))


def test_a_late_row_is_dropped_once_its_window_is_closed(spark, tmp_path):
    arrive(spark, tmp_path / "in", [(1, at(1, 1), 1.0), (2, at(1, 5), 2.0)])
    arrive(spark, tmp_path / "in", [(3, at(2, 1), 4.0), (4, at(1, 23), 8.0)])  # late, its window is open
    arrive(spark, tmp_path / "in", [(5, at(5, 1), 16.0)])  # closes the first days
    arrive(spark, tmp_path / "in", [(8, at(5, 2), 0.5)])  # the watermark for late rows is that of the batch before
    arrive(spark, tmp_path / "in", [(6, at(1, 2), 32.0), (7, at(9, 1), 64.0)])  # too late
    stream = T.stream_table(spark, str(tmp_path / "in"), 1)
    out = T.run_once(T.tumbling(stream, "ts", "1 day", "1 day", [], "value"))
    got = {(r["window"]["start"].day, r["n"], r["total"]) for r in out.collect()}
    assert got == {(1, 3, 11.0), (2, 1, 4.0), (5, 2, 16.5)}


def test_deduplication_survives_a_restart(spark, tmp_path):
    base = str(tmp_path / "run")
    arrive(spark, tmp_path / "in", [(1, at(1, 1), 1.0), (2, at(1, 2), 1.0)])
    T.run_once(T.first_only(T.stream_table(spark, str(tmp_path / "in"), 1), "ts", "3 days", ["id"]), base=base)
    arrive(spark, tmp_path / "in", [(2, at(1, 3), 9.0), (3, at(1, 4), 1.0)])
    out = T.run_once(T.first_only(T.stream_table(spark, str(tmp_path / "in"), 1), "ts", "3 days", ["id"]), base=base)
    assert sorted((r["id"], r["value"]) for r in out.collect()) == [(1, 1.0), (2, 1.0), (3, 1.0)]


def decide(rows):
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


def test_days_that_span_batches_are_decided_once_and_whole(spark, tmp_path):
    sink = str(tmp_path / "sink")
    arrive(spark, tmp_path / "in", [(1, at(1, 1), 1.0), (2, at(2, 1), 1.0)])
    arrive(spark, tmp_path / "in", [(3, at(1, 2), 7.0), (4, at(2, 2), 5.0), (9, None, 100.0)])
    got = T.daily_decisions(T.stream_table(spark, str(tmp_path / "in"), 1), "ts", decide, sink)
    assert got.count() == 0  # both days are open
    arrive(spark, tmp_path / "in", [(5, at(4, 1), 1.0)])
    got = T.daily_decisions(T.stream_table(spark, str(tmp_path / "in"), 1), "ts", decide, sink)
    assert {(r["day"], r["n"], r["top"]) for r in got.collect()} == {("20240301", 2, 7.0), ("20240302", 2, 5.0)}
    arrive(spark, tmp_path / "in", [(6, at(1, 3), 99.0)])  # after the decision
    got = T.daily_decisions(T.stream_table(spark, str(tmp_path / "in"), 1), "ts", decide, sink, finish=True)
    assert {(r["day"], r["n"], r["top"]) for r in got.collect()} == {("20240301", 2, 7.0), ("20240302", 2, 5.0), ("20240304", 1, 1.0)}


def test_interval_maps_keep_state_across_batches(spark, tmp_path):
    for a, b in ((1, 3), (10, 12), (4, 9)):
        spark.createDataFrame([("e", a, b)], "e string, a int, b int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("e string, a int, b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = T.run_once(T.interval_maps(stream, "e", "a", "b"), "update")
    assert [(r["first"], r["last"]) for r in out.filter("version = 3").collect()] == [(1, 12)]
    assert out.filter("version = 2").count() == 2


class Cluster:
    class sparkContext:
        master = "spark://host:7077"

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        shared_folder(Cluster)
