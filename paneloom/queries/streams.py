"""Queries of streams and of files: the same answers as in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import LAST_DAY, day_number, day_string, instrument_code
from ..session import shared_folder
from ..sources import files
from ..sources.tables import table
from ..streaming import streams as T
from .problem_sql import CODE, _NAMES

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return T.stream_table(spark, f"{d}/events.parquet")


def _windows(df: DataFrame, *more: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.select(text("window.start").alias("begin"), text("window.end").alias("finish"), *more)


def _complete(stream: DataFrame) -> DataFrame:
    """The last state of an aggregation, windows that the watermark leaves open included."""
    out = T.run_once(stream, "complete")
    last = out.agg(F.max("_batch")).first()[0]
    return out.filter(F.col("_batch") == last).drop("_batch", "number")


_T = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query(f"select {_T.format('b')} as begin, {_T.format('b + interval 7 day')} as finish, event_type, count(*) as n, round(sum(value), 4) as total from (select *, time_bucket(interval 7 day, ts, timestamp '1970-01-01') as b from events) group by all")
def strm_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _windows(_complete(T.tumbling(_events(spark, d), "ts", "7 days", "1 day", ["event_type"], "value")), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"select {_T.format('b')} as begin, {_T.format('b + interval 2 hour')} as finish, count(*) as n, round(sum(value), 4) as total from (select *, unnest([time_bucket(interval 1 hour, ts, timestamp '1970-01-01'), time_bucket(interval 1 hour, ts, timestamp '1970-01-01') - interval 1 hour]) as b from events) group by all")
def strm_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _windows(_complete(T.sliding(_events(spark, d), "ts", "2 hours", "1 hour", "1 day", [], "value")), "n", F.round("total", 4).alias("total"))


@query(f"with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events), r as (select *, sum(new) over (partition by user_id order by ts) as run from g) select {_T.format('min(ts)')} as begin, user_id, count(*) as n from r group by user_id, run")
def strm_sessions(spark: SparkSession, d: str) -> DataFrame:
    own = T.sessions(_events(spark, d), "ts", "6 hours", "1 day", ["user_id"]).select(F.col("session_window").alias("window"), "user_id", "n")
    return _windows(_complete(own), "user_id", "n").drop("finish")


@query("select event_id, user_id from events")
def strm_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Every event delivered twice, each kept once."""
    e = _events(spark, d)
    twice = e.select("event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2)))).drop("col")
    return T.run_once(T.first_only(twice, "ts", "40 days", ["event_id"])).select("event_id", "user_id")


@query(f"with {_NAMES}, b as (select ts_code, s as a, coalesce(e, date '9999-12-31') as b from names where s is not null and (e is null or e >= s)), ends as (select *, max(b) over (partition by ts_code order by a, b rows between unbounded preceding and 1 preceding) as reach from b), runs as (select *, sum(case when reach is null or a > reach + 1 then 1 else 0 end) over (partition by ts_code order by a, b rows unbounded preceding) as run from ends) select ts_code, strftime(min(a), '%Y%m%d') as from_date, strftime(max(b), '%Y%m%d') as to_date from runs group by ts_code, run")
def strm_interval_maps(spark: SparkSession, d: str) -> DataFrame:
    """Covered periods of names, kept in keyed state as filings arrive."""
    n = T.stream_table(spark, f"{d}/namechange.parquet").select(instrument_code("ts_code").alias("ts_code"), day_number("start_date").alias("a"), F.coalesce(day_number("end_date"), F.lit(LAST_DAY)).alias("b"))
    out = T.run_once(T.interval_maps(n, "ts_code", "a", "b"), "update")
    last = out.groupBy("ts_code").agg(F.max("version").alias("version"))
    return out.join(last, ["ts_code", "version"]).select("ts_code", day_string("first").alias("from_date"), day_string("last").alias("to_date"))


def _arrivals(spark: SparkSession, d: str, files: int = 5) -> str:
    """Events as files of successive stretches of time, each event up to twelve hours out of place: days span files."""
    path = _place(spark, "arrivals")
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.pmod(F.xxhash64("event_id"), F.lit(43_200))
    low, high = e.agg(F.min(at), F.max(at)).first()
    number = F.floor((at - low) / max(1.0, (high - low) / files))
    for i in range(files):
        e.filter((number == i) | ((number >= files) & F.lit(i == files - 1))).coalesce(1).write.mode("append").parquet(path)
    return path


@query("select strftime(ts, '%Y%m%d') as day, count(*) as n, round(max(value), 4) as top from events group by 1")
def strm_daily_decisions(spark: SparkSession, d: str) -> DataFrame:
    """One decision a day from all its rows, which come in several micro-batches; the stream is started twice."""
    path, sink = _arrivals(spark, d), _place(spark, "decisions")

    def decide(rows: DataFrame) -> DataFrame:
        return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("top"))

    T.daily_decisions(T.stream_table(spark, path, 1), "ts", decide, sink)
    return T.daily_decisions(T.stream_table(spark, path, 1), "ts", decide, sink, finish=True)


@query(f"select {_T.format('b')} as begin, {_T.format('b + interval 1 day')} as finish, count(*) as n, round(sum(value), 4) as total from (select *, time_bucket(interval 1 day, ts, timestamp '1970-01-01') as b from events) group by all having b + interval 2 day <= (select max(ts) from events)")
def strm_closed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Append mode over five micro-batches: a window comes out once, when the watermark, a day behind, has passed its end.
    Events are at most half a day out of place, so none is too late."""
    stream = T.stream_table(spark, _arrivals(spark, d), 1)
    return _windows(T.run_once(T.tumbling(stream, "ts", "1 day", "1 day", [], "value")), "n", F.round("total", 4).alias("total"))


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/paneloom/{name}-{uuid.uuid4().hex}"


@query("select s_suppkey, s_name from supplier where s_suppkey between 5 and 60")
def io_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "csv")
    t = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    t.write.option("header", True).csv(path)
    return files.read_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double", ["s_suppkey", "s_name"], ("s_suppkey", "5", "60"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def io_json(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "json")
    table(spark, d, "events").select(F.to_json(F.struct("event_id", F.from_json("props", "k long").alias("props"))).alias("value")).write.text(path)
    return files.read_json(spark, path, "event_id long, props struct<k: long>").select("event_id", "props.k")


@query("select o_orderstatus, count(*) as n from orders group by 1")
def io_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Written by partition, one partition written again."""
    path = _place(spark, "parts")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    files.write_partitioned(o, path, ["o_orderstatus"])
    files.write_partitioned(o.filter("o_orderstatus = 'F'"), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as rows, true as equal, false as equal_after_a_change from customer")
def io_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Digests of a table, of the same table written in another order and of one with a changed cell."""
    own = table(spark, d, "customer")
    again, changed = _place(spark, "again"), _place(spark, "changed")
    own.orderBy(F.desc("c_custkey")).write.parquet(again)
    own.withColumn("c_name", F.when(F.col("c_custkey") == own.agg(F.min("c_custkey")).first()[0], "x").otherwise(F.col("c_name"))).write.parquet(changed)
    whole = [files.manifest(t).agg(F.sum("rows").alias("rows"), F.bit_xor("digest").alias("digest")) for t in (own, spark.read.parquet(again), spark.read.parquet(changed))]
    a, b, c = (w.select(*(F.col(x).alias(f"{x}{i}") for x in w.columns)) for i, w in enumerate(whole))
    met = a.join(b, F.col("rows0") == F.col("rows1")).join(c, F.col("rows0") == F.col("rows2"))
    return met.select(F.col("rows0").alias("rows"), (F.col("digest0") == F.col("digest1")).alias("equal"), (F.col("digest0") == F.col("digest2")).alias("equal_after_a_change"))


@query("select r_regionkey, r_name from region")
def io_repeated_header(spark: SparkSession, d: str) -> DataFrame:
    """A calendar-like CSV that several runs appended to, each with its header line."""
    path = _place(spark, "headers")
    lines = table(spark, d, "region").select(F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name").alias("value"))
    head = spark.createDataFrame([("r_regionkey,r_name",)] * 3, "value string")
    head.limit(1).unionByName(lines).unionByName(head).coalesce(1).write.text(path)
    out = files.read_csv(spark, path, "r_regionkey string, r_name string", repeated_header=True)
    return out.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 200000")
def io_pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    """One partition and a range of a partitioned table: both reach the scan."""
    path = _place(spark, "pruned")
    files.write_partitioned(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return spark.read.parquet(path).filter("o_orderstatus = 'F' and o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("select n_nationkey, n_name from nation")
def io_orc(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "orc")
    table(spark, d, "nation").write.orc(path)
    return spark.read.orc(path).select("n_nationkey", "n_name")


@query(f"select distinct {CODE} as ts_code from stock_basic")
def io_append_facts(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "facts")
    s = table(spark, d, "stock_basic").select(instrument_code("ts_code").alias("ts_code"))
    files.append_facts(s, path, "ts_code")
    files.append_facts(s, path, "ts_code")
    return spark.read.parquet(path)
