"""Queries of the data problems 1 to 7, each over its whole tables."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import LAST_DAY, UNKNOWN_WORDS, compact_date, day_string, finite, instrument_code, is_filler
from ..operators.copies import difference
from ..operators.impute import Cell, fill_from_similar, held_out_error
from ..operators.intervals import coverage
from ..operators.ledger import bitemporal_ledger, periods
from ..operators.rolling import trailing_totals
from ..operators.spikes import impossible, leaves_range, level_candidates, rate_breaks, with_normal_ranges, with_stuck
from ..operators.versions import attributes_at
from ..session import written
from ..sources.tables import coded, daily_rows, distinct_rows, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["ts_code", "trade_date"]
    raw = table(spark, d, "stk_factor")
    copy = raw.select(instrument_code("ts_code").alias("ts_code"), compact_date("trade_date").alias("trade_date"), "close", "adj_factor")
    daily = daily_rows(spark, d, "close").select("ts_code", day_string("day").alias("trade_date"), "close")
    factor = table(spark, d, "adj_factor").select(instrument_code("ts_code").alias("ts_code"), compact_date("trade_date").alias("trade_date"), "adj_factor")
    n = raw.count()  # from the files' footers
    return difference(daily, copy, keys, {"close": 0.005}, n).unionByName(difference(factor, copy, keys, {"adj_factor": 0.0005}, n))


def _known_names(spark: SparkSession, d: str) -> DataFrame:
    return coded(table(spark, d, "namechange"), "start_date", "end_date", "ann_date")


def _with_names(spark: SparkSession, d: str, wide: list[str]) -> DataFrame:
    raw = coded(table(spark, d, "dividend").select("div_id", "ts_code", "ann_date", "ex_date"), "ann_date", "ex_date")
    moments = F.explode(F.array(F.struct(F.lit("ann").alias("moment"), F.col("ann_date").alias("day")), F.struct(F.lit("ex").alias("moment"), F.col("ex_date").alias("day"))))
    events = raw.select("div_id", "ts_code", moments.alias("m")).select("div_id", "ts_code", "m.moment", "m.day")
    return attributes_at(events, _known_names(spark, d), "ts_code", "day", F.col("start_date"), F.col("end_date"), F.col("ann_date"), wide, [F.col("nc_id")])


def p2_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Every dividend row and moment with the name in force and known then; null attributes where there is none."""
    found = _with_names(spark, d, ["nc_id", "name", "change_reason"])
    return found.select("div_id", "moment", day_string("day").alias("on_date"), "attrs.nc_id", "attrs.name", "attrs.change_reason")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _with_names(spark, d, ["nc_id"]).select("div_id", "moment", "attrs.nc_id").filter(F.col("nc_id").isNotNull()).distinct()


def _trailing(spark: SparkSession, d: str) -> DataFrame:
    raw = coded(table(spark, d, "daily").select("ts_code", "trade_date", "ingested_at", "amount"), "trade_date")
    basic = coded(table(spark, d, "daily_basic").select("ts_code", "trade_date", "turnover_rate"), "trade_date")
    none = F.lit(None)
    both = raw.select("ts_code", F.col("trade_date").alias("day"), F.coalesce("ingested_at", F.lit("0001-01-02").cast("timestamp")).alias("at"), "amount", none.cast("double").alias("turnover_rate"))
    both = both.unionByName(basic.select("ts_code", F.col("trade_date").alias("day"), none.cast("timestamp").alias("at"), none.cast("double").alias("amount"), "turnover_rate"))
    rows = both.filter(F.col("day").isNotNull()).groupBy("ts_code", "day").agg(F.max_by("amount", "at").alias("amount"), F.max("turnover_rate").alias("turnover_rate"))
    spans = raw.groupBy("ts_code").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    return trailing_totals(rows, spans, "ts_code", "day", ["amount", "turnover_rate"], [7, 30])


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of every instrument and calendar day."""
    t = _trailing(spark, d)
    sums = [F.round(f"{m}_{n}", 4).alias(f"{m}_total_{n}") for m in ("amount", "turnover_rate") for n in (7, 30)]
    means = [F.round(F.col(f"{m}_{n}") / n, 6).alias(f"{m}_mean_{n}") for m in ("amount", "turnover_rate") for n in (7, 30)]
    return t.select("ts_code", day_string("day").alias("cal_date"), *sums, *means)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = _trailing(spark, d)

    def burst(m: str):
        return (F.col("day_no") >= 30) & (F.col(f"{m}_30") > 0) & (F.col(f"{m}_7") / 7 >= 2 * F.col(f"{m}_30") / 30)

    kinds = F.array_compact(F.array(F.when(F.col("amount_7") == 0, "idle"), F.when(burst("amount"), "amount_burst"), F.when(burst("turnover_rate"), "turnover_burst")))
    return t.select("ts_code", day_string("day").alias("cal_date"), F.explode(kinds).alias("kind"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    traded = F.coalesce(F.col("amount") != 0, F.lit(True))
    rows = daily_rows(spark, d, "close", "pct_chg", "pre_close", "change", "amount")
    rows = level_candidates(rows, "ts_code", "day", "close", before=F.col("pre_close"))
    rows = written(with_stuck(rows, "ts_code", "day", ["close", "pct_chg"], traded))
    rates = F.when(~impossible(F.col("pct_chg"), False), F.col("pct_chg"))
    rows = with_normal_ranges(rows, "ts_code", "day", {"close": (F.col("_step"), 2.0), "pct_chg": (rates, 3.0)})
    rows = rows.withColumn("_close_bad", F.col("_bad") | F.col("_stuck_close") | leaves_range(F.col("_off"), "close"))
    rows = rate_breaks(rows, "ts_code", "day", "pct_chg", "close", "_close_bad", "pre_close", "change")
    fields = F.array_compact(F.array(F.when(F.col("_close_bad"), "close"), F.when(F.col("_rate_bad") | F.col("_stuck_pct_chg"), "pct_chg")))
    found = rows.filter(traded).select("ts_code", "day", F.explode(fields).alias("field"))

    factors = written(level_candidates(distinct_rows(spark, d, "adj_factor", "adj_factor"), "ts_code", "day", "adj_factor", least=0.01))
    factors = with_normal_ranges(factors, "ts_code", "day", {"adj_factor": (F.col("_step"), 2.0)})
    factors = factors.filter(F.col("_bad") | leaves_range(F.col("_off"), "adj_factor"))
    found = found.unionByName(factors.select("ts_code", "day", F.lit("adj_factor").alias("field")))
    return found.select("ts_code", day_string("day").alias("trade_date"), "field")


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return coded(table(spark, d, "stock_basic").select("ts_code", "list_date", "delist_date"), "list_date", "delist_date")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    names = coded(table(spark, d, "namechange").select("ts_code", "start_date", "end_date"), "start_date", "end_date")
    found = coverage(names, _listing(spark, d), "ts_code", "start_date", "end_date", "list_date", "delist_date")
    return found.select("ts_code", "kind", day_string("from_day").alias("from_date"), day_string("to_day").alias("to_date"))


@F.pandas_udf(T.StringType())
def plain_name(names: pd.Series) -> pd.Series:
    """Unicode NFKC without white space; null stays null."""
    return names.map(lambda x: "".join(unicodedata.normalize("NFKC", x).split()), na_action="ignore")


def p6_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The whole ledger: what was believed of which days, when."""
    filings = _known_names(spark, d).join(_listing(spark, d), "ts_code", "left").withColumn("end_date", F.coalesce("end_date", F.lit(LAST_DAY)))
    cut = filings.filter(F.col("start_date") <= F.col("end_date")).withColumns(
        {"from_date": F.greatest("start_date", "list_date"), "end_date": F.least("end_date", "delist_date"), "plain": plain_name("name")}
    )
    return bitemporal_ledger(cut, "ts_code", "start_date", "end_date", "ann_date", "nc_id", "plain", begin="from_date")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    now = p6_ledger(spark, d).filter(F.col("recorded_to").isNull())
    found = periods(now, "ts_code", "value", "valid_from", "valid_to")
    return found.select("ts_code", F.col("value").alias("name"), day_string("valid_from").alias("valid_from"), day_string("valid_to").alias("valid_to"))


def _suffix() -> F.col:
    return F.substring_index("ts_code", ".", -1)


def _free_share(spark: SparkSession, d: str) -> tuple:
    rows = coded(table(spark, d, "daily_basic").select("ts_code", "trade_date", "total_share", "float_share", "free_share")).withColumn("trade_date", compact_date("trade_date"))
    v = finite("free_share")
    numeric = {c: F.when(F.col(c) > 0, F.ln(c)) for c in ("total_share", "float_share")}
    return rows, Cell(F.when((v > 0) & ~is_filler(v), v), scale=finite("float_share")), numeric, {"board": _suffix()}


def p7_free_share(spark: SparkSession, d: str) -> DataFrame:
    rows, cell, numeric, categorical = _free_share(spark, d)
    return fill_from_similar(rows, "ts_code", {"free_share": cell}, numeric, categorical)


def _up_limit(spark: SparkSession, d: str) -> tuple:
    rows = coded(table(spark, d, "stk_limit").select("ts_code", "trade_date", "pre_close", "up_limit", "down_limit")).withColumn("trade_date", compact_date("trade_date"))
    v = finite("up_limit")
    low = finite("down_limit") / F.when(F.col("pre_close") > 0, F.col("pre_close"))
    fillable = F.col("up_limit").isNotNull() | F.col("down_limit").isNotNull()
    return rows, Cell(F.when((v > 0) & ~is_filler(v), v), fillable, finite("pre_close")), {"low": low, "price": F.when(F.col("pre_close") > 0, F.ln("pre_close"))}, {"board": _suffix()}


def p7_up_limit(spark: SparkSession, d: str) -> DataFrame:
    rows, cell, numeric, categorical = _up_limit(spark, d)
    return fill_from_similar(rows, "ts_code", {"up_limit": cell}, numeric, categorical)


def p7_quality(spark: SparkSession, d: str) -> DataFrame:
    """How well hidden cells are found again, by clusters and by groups alone."""
    days, runs = ["ts_code", "trade_date"], ["experiment_id", "factor_id"]
    others = {c: F.col(c) for c in ("icir_mean", "ic_mean", "regime_bull_icir", "regime_volatile_icir")}
    rows = _performance(spark, d).distinct()
    out = None
    for name, keys, (rows, cell, numeric, categorical) in (
        ("free_share", days, _free_share(spark, d)), ("up_limit", days, _up_limit(spark, d)),
        ("regime_bear_icir", runs, (rows, Cell(_icir()), others, {"category": _category(), "status": F.col("status")})), ("category", runs, (rows, Cell(_category()), others, {"status": F.col("status")})),
    ):
        found = held_out_error(rows, keys, keys[0] if keys is days else keys[1], name, cell, numeric, categorical)
        part = found.select(F.lit(name).alias("field"), "hidden", *(F.round(c, 6).alias(c) for c in ("cluster_error", "group_error")))
        out = part if out is None else out.unionByName(part)
    return out


def _category() -> F.col:
    c = F.lower(F.trim(F.regexp_replace("category", r"\s+", " ")))
    return F.when(~c.isin(*UNKNOWN_WORDS), c)


def _icir() -> F.col:
    v = finite("regime_bear_icir")
    return F.when(~is_filler(v), v)


def _performance(spark: SparkSession, d: str) -> DataFrame:
    keep = ("experiment_id", "factor_id", "category", "icir_mean", "ic_mean", "regime_bull_icir", "regime_bear_icir", "regime_volatile_icir", "status")
    return table(spark, d, "factor_performance").select(*keep)


def p7_performance(spark: SparkSession, d: str) -> DataFrame:
    """Both columns of factor_performance from one fit over all that rows have, the two columns' own values included."""
    rows = _performance(spark, d)
    numeric = {c: F.col(c) for c in ("icir_mean", "ic_mean", "regime_bull_icir", "regime_volatile_icir")} | {"bear": _icir()}
    return fill_from_similar(rows, "factor_id", {"regime_bear_icir": Cell(_icir()), "category": Cell(_category())}, numeric, {"category": _category(), "status": F.col("status")})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for tbl, k1, k2, fields, filled in (
        ("daily_basic", "ts_code", "trade_date", ["free_share"], p7_free_share(spark, d)), ("stk_limit", "ts_code", "trade_date", ["up_limit"], p7_up_limit(spark, d)),
        ("factor_performance", "experiment_id", "factor_id", ["regime_bear_icir", "category"], p7_performance(spark, d)),
    ):
        own = F.explode(F.array_compact(F.array(*(F.when(F.col(f"{f}_filled") & F.col(f"{f}_method").isin("cluster", "group"), f) for f in fields))))
        part = filled.select(F.lit(tbl).alias("tbl"), F.col(k1).alias("key1"), F.col(k2).alias("key2"), own.alias("field"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_attributes, p3_found, p3_rolling, p4_found, p5_found, p6_found, p6_ledger, p7_found, p7_free_share, p7_up_limit, p7_performance, p7_quality)}
