"""Queries of labels, rank correlations and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..functions.normal import quantile_sql
from ..operators import statistics as S
from ..plans.duck_backend import named
from ..plans.nodes import Node, fn, lag, mean, pct, std
from ..plans.factors import c, o, r, turnover
from ..plans.spark_backend import evaluate
from ..sources.panel import dense_panel, panel_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def lead(x: Node, k: int) -> Node:
    return fn("lead", x, par=(k,))


SIGNALS: dict[str, Node] = {
    "score": fn("xrank_mid", -pct(c, 5)),
    "quiet": fn("xrank_mid", -std(r, 10)),
    "thin": fn("xrank_mid", -mean(turnover, 5)),
    "label": lead(c, 1) / c - 1,
}
MIN = 3
_FIELDS = ["open", "close", "turnover", "circ_mv"]
_KEEP = ["ts_code", "trade_date", "idx", "circ_mv", "industry", "exchange"]


def scored(spark: SparkSession, d: str, extra: dict[str, Node] | None = None) -> DataFrame:
    """The panel with three signals and the next session's return, rounded so that both engines rank alike."""
    own = SIGNALS | (extra or {})
    panel = evaluate(dense_panel(spark, d, _FIELDS, True), own)
    return panel.select(*_KEEP, *((F.round(s, 8) + 0.0).alias(s) for s in own))


def scored_sql(extra: dict[str, Node] | None = None) -> str:
    return panel_sql(_FIELDS, True) + named("scored", "panel", SIGNALS | (extra or {}), _KEEP, digits=8)


def r6(df: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    return df.select(*keep, *((F.round(v, 6) + 0.0).alias(v) for v in values))


def _corr(x: str, y: str) -> str:
    sx, sy = f"stddev_pop({x})", f"stddev_pop({y})"
    return f"case when {sx} > 1e-12 and {sy} > 1e-12 and {sx} > abs(avg({x})) * 1e-12 and {sy} > abs(avg({y})) * 1e-12 then greatest(-1.0, least(1.0, covar_pop({x}, {y}) / ({sx} * {sy}))) end"


def _rank(x: str, by: str) -> str:
    return f"rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2"


def ic_sql(by: str, source: str = "scored", least: int = MIN, score: str = "score", label: str = "label", name: str = "ic") -> str:
    """``, ic as (by, n, pearson, spearman)``."""
    return f""", {name}_r as (select *, {_rank(score, by)} as rs, {_rank(label, by)} as rl from {source} where {score} is not null and {label} is not null),
{name}_g as (select {by}, count(*) as n, {_corr(score, label)} as p, {_corr('rs', 'rl')} as s from {name}_r group by {by}),
{name} as (select {by}, n, case when n >= {least} and p is not null and s is not null then p end as pearson, case when n >= {least} and p is not null and s is not null then s end as spearman from {name}_g)"""


def _describe_sql(by: str = "", value: str = "spearman", source: str = "ic", sd: str = "stddev_samp") -> str:
    keep = f"{by}, " if by else ""
    ratio = f"case when {sd}({value}) > 1e-12 then avg({value}) / {sd}({value}) end"
    tail = f" group by {by}" if by else ""
    return f" select {keep}count({value}) as n, round(avg({value}), 6) + 0.0 as mean, round({sd}({value}), 6) as sd, round(avg(({value} > 1e-9)::int), 6) as positive, round({ratio}, 6) + 0.0 as icir, round({ratio} * sqrt(count({value})), 6) + 0.0 as t from {source} where {value} is not null{tail}"


BASE = scored_sql()
_DESCRIBED = ["mean", "sd", "positive", "icir", "t"]
_LABELS = {"kernel": lead(c, 2) / lead(o, 1) - 1, "forward_5": lead(c, 5) / c - 1}


@query(scored_sql(_LABELS) + " select ts_code, trade_date, kernel, forward_5 from scored")
def stat_labels(spark: SparkSession, d: str) -> DataFrame:
    """Entry at the next open and exit a close later; and the plain five-session return."""
    return scored(spark, d, _LABELS).select("ts_code", "trade_date", "kernel", "forward_5")


@query(BASE + ic_sql("trade_date") + " select trade_date, n, round(pearson, 6) + 0.0 as pearson, round(spearman, 6) + 0.0 as spearman from ic")
def stat_daily_ic(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.rank_ic(scored(spark, d), ["trade_date"], least=MIN), ["trade_date", "n"], ["pearson", "spearman"])


@query(BASE + ic_sql("trade_date") + _describe_sql())
def stat_ic_summary(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.describe(S.rank_ic(scored(spark, d), ["trade_date"], least=MIN), "spearman"), ["n"], _DESCRIBED)


@query(BASE + ic_sql("trade_date", least=30) + _describe_sql(sd="stddev_pop"))
def stat_ic_population(spark: SparkSession, d: str) -> DataFrame:
    """The library's summary: sessions with 30 names at least, population deviation."""
    return r6(S.describe(S.rank_ic(scored(spark, d), ["trade_date"], least=30), "spearman", ddof=0), ["n"], _DESCRIBED)


@query(BASE + " select trade_date, count(*) as universe, count(score) as signals, count(label) as labels, count(*) filter (score is not null and label is not null) as pairs from scored group by 1")
def stat_coverage(spark: SparkSession, d: str) -> DataFrame:
    return S.coverage(scored(spark, d), "trade_date", "score", "label")


@query(BASE + f", f as (select * from scored where score is not null and label is not null), g as (select *, ({_rank('score', 'trade_date')}) - ({_rank('label', 'trade_date')}) as dd from f) select trade_date, count(*) as n, round(case when count(*) >= {MIN} then 1 - 6 * sum(dd * dd) / (count(*) * (count(*) * count(*) - 1.0)) end, 6) + 0.0 as ic from g group by 1")
def stat_closed_form_ic(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.closed_form_ic(scored(spark, d), ["trade_date"], least=MIN), ["trade_date", "n"], ["ic"])


_LAGS = (1, 2, 3, 5, 10)
_DECAY = {f"l{k}": lead(c, k) / c - 1 for k in _LAGS}


def _decay(spark: SparkSession, d: str) -> DataFrame:
    own, out = scored(spark, d, _DECAY), None
    for k in _LAGS:
        part = S.rank_ic(own, ["trade_date"], label=f"l{k}", least=MIN).agg(F.lit(k).alias("lag"), F.avg("spearman").alias("ic"))
        out = part if out is None else out.unionByName(part)
    return out


_DECAY_SQL = scored_sql(_DECAY) + "".join(ic_sql("trade_date", label=f"l{k}", name=f"ic{k}") for k in _LAGS) + ", dec as (" + " union all ".join(f"select {k} as lag, avg(spearman) as ic from ic{k}" for k in _LAGS) + ")"


@query(_DECAY_SQL + " select lag, round(ic, 6) + 0.0 as ic from dec")
def stat_ic_decay(spark: SparkSession, d: str) -> DataFrame:
    return r6(_decay(spark, d), ["lag"], ["ic"])


@query(_DECAY_SQL + ", y as (select lag - 1 as x, ln(case when abs(ic) > 1e-12 then abs(ic) end / (select case when abs(ic) > 1e-12 then abs(ic) end from dec where lag = 1)) as y from dec), fit as (select -sum(x * y) / sum(x * x) as rate from y where x > 0 and y is not null) select round(rate, 5) + 0.0 as rate, round(case when rate > 0 then ln(2.0) / rate end, 4) as half_life from fit")
def stat_half_life(spark: SparkSession, d: str) -> DataFrame:
    return S.half_life(_decay(spark, d)).select((F.round("rate", 5) + 0.0).alias("rate"), F.round("half_life", 4).alias("half_life"))


@query(scored_sql({"old": lag(SIGNALS["score"], 1)}) + ic_sql("trade_date", score="old", name="ic_old") + ic_sql("trade_date") + " select a.trade_date, round(a.spearman, 6) + 0.0 as now, round(b.spearman, 6) + 0.0 as lagged from ic a join ic_old b using (trade_date)")
def stat_lag_one_ic(spark: SparkSession, d: str) -> DataFrame:
    own = scored(spark, d, {"old": lag(SIGNALS["score"], 1)})
    a = S.rank_ic(own, ["trade_date"], least=MIN).select("trade_date", F.col("spearman").alias("now"))
    b = S.rank_ic(own, ["trade_date"], score="old", least=MIN).select("trade_date", F.col("spearman").alias("lagged"))
    return r6(a.join(b, "trade_date"), ["trade_date"], ["now", "lagged"])


@query(BASE + ic_sql("trade_date") + ", y as (select *, trade_date[1:4] as year from ic)" + _describe_sql("year", source="y"))
def stat_yearly_ic(spark: SparkSession, d: str) -> DataFrame:
    own = S.rank_ic(scored(spark, d), ["trade_date"], least=MIN).withColumn("year", F.substring("trade_date", 1, 4))
    return r6(S.describe(own, "spearman", ["year"]), ["year", "n"], _DESCRIBED)


@query(BASE + ic_sql("trade_date, exchange", least=3) + _describe_sql("exchange"))
def stat_ic_by_exchange(spark: SparkSession, d: str) -> DataFrame:
    own = S.rank_ic(scored(spark, d), ["trade_date", "exchange"], least=3)
    return r6(S.describe(own, "spearman", ["exchange"]), ["exchange", "n"], _DESCRIBED)


@query(BASE + ic_sql("trade_date, industry", least=3) + _describe_sql("industry"))
def stat_conditional_ic(spark: SparkSession, d: str) -> DataFrame:
    own = S.rank_ic(scored(spark, d), ["trade_date", "industry"], least=3)
    return r6(S.describe(own, "spearman", ["industry"]), ["industry", "n"], _DESCRIBED)


@query(BASE + ", b as (select *, ntile(3) over (partition by trade_date order by circ_mv, ts_code) as bucket from scored where circ_mv is not null)" + ic_sql("trade_date, bucket", source="b", least=3) + _describe_sql("bucket").replace("select bucket,", "select cast(bucket as int) as bucket,"))
def stat_ic_by_size(spark: SparkSession, d: str) -> DataFrame:
    own = scored(spark, d).filter("circ_mv is not null").withColumn("bucket", F.ntile(3).over(Window.partitionBy("trade_date").orderBy("circ_mv", "ts_code")))
    return r6(S.describe(S.rank_ic(own, ["trade_date", "bucket"], least=3), "spearman", ["bucket"]), ["bucket", "n"], _DESCRIBED)


@query(BASE + ", m as (select idx, avg(label) as m from scored group by 1), g as (select idx, case when count(m) over w = 20 then (avg(m) over w > 0) end as bull from m window w as (order by idx rows 19 preceding)), b as (select s.*, g.bull from scored s join g using (idx) where g.bull is not null)" + ic_sql("trade_date, bull", source="b") + _describe_sql("bull"))
def stat_ic_by_regime(spark: SparkSession, d: str) -> DataFrame:
    """Sessions after which the mean market return of 20 sessions was above zero, and the others; full windows only."""
    own = scored(spark, d)
    w = Window.orderBy("idx").rowsBetween(-19, 0)  # one row a session
    market = own.groupBy("idx").agg(F.avg("label").alias("m"))
    bull = market.select("idx", F.when(F.count("m").over(w) == 20, F.avg("m").over(w) > 0).alias("bull")).filter("bull is not null")
    return r6(S.describe(S.rank_ic(own.join(bull, "idx"), ["trade_date", "bull"], least=MIN), "spearman", ["bull"]), ["bull", "n"], _DESCRIBED)


@query(BASE + f""", f as (select *, avg(label) over w as my, avg(score) over w as mx, covar_pop(score, label) over w as cxy, var_pop(score) over w as vx, count(*) over w as n from scored where score is not null and label is not null window w as (partition by trade_date)),
e as (select *, label - my - case when vx > 1e-12 then cxy / vx else 0 end * (score - mx) as res from f where n >= 6), t as (select *, ntile(3) over (partition by trade_date order by round(abs(res), 8), ts_code) as domain from e)""" + ic_sql("trade_date, domain", source="t", least=2) + _describe_sql("domain").replace("select domain,", "select cast(domain as int) as domain,"))
def stat_ic_by_domain(spark: SparkSession, d: str) -> DataFrame:
    """Thirds of the names by how far they lie off the session's regression line."""
    w = Window.partitionBy("trade_date")
    own = S.pairs(scored(spark, d), "score", "label").withColumns({"_my": F.avg("label").over(w), "_mx": F.avg("score").over(w), "_c": F.covar_pop("score", "label").over(w), "_v": F.var_pop("score").over(w), "_n": F.count(F.lit(1)).over(w)})
    slope = F.when(F.col("_v") > 1e-12, F.col("_c") / F.when(F.col("_v") != 0, F.col("_v"))).otherwise(0.0)
    own = own.filter("_n >= 6").withColumn("res", F.abs(F.col("label") - F.col("_my") - slope * (F.col("score") - F.col("_mx"))))
    own = own.withColumn("domain", F.ntile(3).over(w.orderBy(F.round("res", 8), "ts_code")))
    return r6(S.describe(S.rank_ic(own, ["trade_date", "domain"], least=2), "spearman", ["domain"]), ["domain", "n"], _DESCRIBED)


@query(panel_sql() + ", w as (select *, date_trunc('week', strptime(trade_date, '%Y%m%d'))::date + 6 as week from panel), bars as (select ts_code, week, arg_max(close, trade_date) filter (close is not null) as close from w group by all), g as (select ts_code, week, case when lag(close) over o > 0 then round(close / lag(close) over o - 1, 8) end as score, case when close > 0 then round(lead(close) over o / close - 1, 8) end as label from bars window o as (partition by ts_code order by week))" + ic_sql("week", source="g") + " select strftime(week, '%Y%m%d') as week, n, round(spearman, 6) + 0.0 as spearman from ic")
def stat_weekly_ic(spark: SparkSession, d: str) -> DataFrame:
    bars = R.weekly_bars(dense_panel(spark, d), F.to_date("trade_date", "yyyyMMdd"))
    o = Window.partitionBy("ts_code").orderBy("week")
    gain = lambda to, of: F.when(of > 0, F.round(to / of - 1, 8))
    own = bars.select("ts_code", "week", gain(F.col("close"), F.lag("close").over(o)).alias("score"), gain(F.lead("close").over(o), F.col("close")).alias("label"))
    return S.rank_ic(own, ["week"], least=MIN).select(F.date_format("week", "yyyyMMdd").alias("week"), "n", (F.round("spearman", 6) + 0.0).alias("spearman"))


_ZED = {"zed": fn("xz", -pct(c, 5), par=("mean", 1, 2))}
_H = ", ".join(f"count(*) filter (b = {i}) as h{i}" for i in range(10))
_PQ = ", ".join(f"(h{i} + 1.0) / (n + 10) as p{i}" for i in range(10))


@query(scored_sql(_ZED) + f", s as (select idx, least(greatest(floor((zed + 3.5) / 7.0 * 10), 0), 9) as b from scored where zed is not null), h as (select idx, count(*) as n, {_H} from s group by 1), p as (select idx, {_PQ} from h), k as (select {' + '.join(f'p{i} * ln(p{i} / lag(p{i}) over (order by idx))' for i in range(10))} as kl from p) select round(avg(kl), 6) as distance, round(1 / (1 + avg(kl)), 6) as persistence from k")
def stat_rank_entropy(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.histogram_persistence(scored(spark, d, _ZED), "idx", "zed"), [], ["distance", "persistence"])


@query(BASE + f", g as (select trade_date, {_corr('score', 'quiet')} as c from scored where score is not null and quiet is not null group by 1 having count(*) >= {MIN}) select round(avg(abs(c)), 6) as similarity from g")
def stat_paired_correlation(spark: SparkSession, d: str) -> DataFrame:
    own = S.pairs(scored(spark, d), "score", "quiet").groupBy("trade_date").agg(F.when(F.count(F.lit(1)) >= MIN, S.correlation("score", "quiet")).alias("c"))
    return own.agg(F.round(F.avg(F.abs("c")), 6).alias("similarity"))


# Portfolios

_QR = f", f as (select *, count(*) over (partition by trade_date) as n from scored where score is not null and label is not null), q as (select *, cast(ntile(5) over (partition by trade_date order by score, ts_code) as int) as quantile from f where n >= 10), qr as (select trade_date, quantile, avg(label) as label, count(*) as n from q group by all)"


@query(BASE + _QR + " select trade_date, quantile, round(label, 6) + 0.0 as label, n from qr")
def port_quantile_returns(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.quantile_returns(scored(spark, d), "trade_date", "score", "label", 5, 10), ["trade_date", "quantile", "n"], ["label"])


@query(BASE + _QR + f", m as (select quantile, avg(label) as m from qr group by 1), x as (select *, case when lag(m) over (order by quantile) is not null then (m > lag(m) over (order by quantile))::int end as up, rank() over (order by m) as r from m) select round(arg_max(m, quantile) - arg_min(m, quantile), 6) + 0.0 as spread, round({_corr('r', 'quantile')}, 6) + 0.0 as \"order\", round(avg(up), 6) as rising from x")
def port_monotonicity(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.monotonicity(S.quantile_returns(scored(spark, d), "trade_date", "score", "label", 5, 10)), [], ["spread", "order", "rising"])


@query(BASE + ", f as (select label, row_number() over (partition by trade_date order by score, ts_code) / count(*) over (partition by trade_date) as p from scored where score is not null and label is not null) select cast(least(floor(p * 10), 9) as int) as decile, round(avg(label), 6) + 0.0 as label, count(*) as n from f group by 1")
def port_decile_curve(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.decile_curve(scored(spark, d), "trade_date", "score", "label"), ["decile", "n"], ["label"])


@query(BASE + ", f as (select *, cast(ntile(3) over (partition by trade_date order by circ_mv, ts_code) as int) as size_group from scored where score is not null and label is not null and circ_mv is not null), g as (select *, cast(ntile(5) over (partition by trade_date, size_group order by score, ts_code) as int) as score_group from f) select size_group, score_group, round(avg(label), 6) + 0.0 as label, count(*) as n from g group by all")
def port_double_sort(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.double_sort(scored(spark, d), "trade_date", "circ_mv", "score", "label"), ["size_group", "score_group", "n"], ["label"])


@query(BASE + ", f as (select *, ntile(2) over (partition by trade_date order by circ_mv, ts_code) as g from scored where label is not null and circ_mv is not null), s as (select trade_date, avg(label) filter (g = 1) - avg(label) filter (g = 2) as v from f group by 1) select count(v) as n, round(avg(v), 6) + 0.0 as spread, round(avg(v) / stddev_samp(v) * sqrt(count(v)), 5) + 0.0 as t from s")
def port_size_sort(spark: SparkSession, d: str) -> DataFrame:
    """Small less big, half and half, with its t statistic."""
    own = scored(spark, d).filter("label is not null and circ_mv is not null").withColumn("g", F.ntile(2).over(Window.partitionBy("trade_date").orderBy("circ_mv", "ts_code")))
    v = own.groupBy("trade_date").agg((F.avg(F.when(F.col("g") == 1, F.col("label"))) - F.avg(F.when(F.col("g") == 2, F.col("label")))).alias("v"))
    return v.agg(F.count("v").alias("n"), (F.round(F.avg("v"), 6) + 0.0).alias("spread"), (F.round(F.avg("v") / F.stddev_samp("v") * F.sqrt(F.count("v")), 5) + 0.0).alias("t"))


@query(BASE + f", rk as (select ts_code, idx, {_rank('quiet', 'idx')} as r from scored where quiet is not null), " + ", ".join(f"a{k} as (select n.idx, case when count(*) >= {MIN} then {_corr('n.r', 'o.r')} end as c from rk n join rk o on n.ts_code = o.ts_code and n.idx = o.idx + {k} group by 1)" for k in (1, 2, 4)) + " " + " union all ".join(f"select {k} as lag, round(avg(c), 6) as autocorrelation from a{k}" for k in (1, 2, 4)))
def port_rank_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.rank_autocorrelation(scored(spark, d), "ts_code", "idx", "quiet", [1, 2, 4], MIN), ["lag"], ["autocorrelation"])


@query(BASE + ", t as (select ts_code, idx from scored where quiet is not null qualify row_number() over (partition by idx order by quiet desc, ts_code) <= 5) select a.idx, count(*) as held, count(b.ts_code) as kept, round(1 - count(b.ts_code) / count(*), 6) as turnover from t a left join t b on a.ts_code = b.ts_code and a.idx = b.idx + 1 group by 1")
def port_top_turnover(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.top_turnover(scored(spark, d), "ts_code", "idx", "quiet", 5), ["idx", "held", "kept"], ["turnover"])


_PAIRS = [("quiet", "score"), ("quiet", "thin"), ("score", "thin")]


def _mean_rank_corr(a: str, b: str, digits: int = 6) -> str:
    ra, rb = (f"case when {x} is not null then rank() over (partition by trade_date, {x} is null order by {x}) + (count(*) over (partition by trade_date, {x}) - 1) / 2 end" for x in (a, b))
    return f"select '{a}' as one, '{b}' as other, round(avg(c), {digits}) as correlation from (select trade_date, case when count(*) >= {MIN} then {_corr('x', 'y')} end as c from (select trade_date, {ra} as x, {rb} as y from scored) where x is not null and y is not null group by 1)"


@query(BASE + " " + " union all ".join(_mean_rank_corr(a, b) for a, b in _PAIRS))
def port_correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.correlation_matrix(scored(spark, d), "trade_date", ["quiet", "score", "thin"], MIN), ["one", "other"], ["correlation"])


@query(BASE + " select ts_code, trade_date, round(case when score is null and quiet is null then null else (coalesce(score * 0.7, 0) + coalesce(quiet * 0.3, 0)) / (case when score is null then 0 else 0.7 end + case when quiet is null then 0 else 0.3 end) end, 6) as combined, round(score * 0.5 + quiet * 0.5, 6) as mixed, round(exp(ln(case when score > 0 then score end) * 0.6 + ln(1.000001 - quiet) * 0.4), 6) as product from scored")
def port_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean, half-and-half mix and rank product (the second rank inverted) of two signals."""
    own = scored(spark, d)
    made = own.select("ts_code", "trade_date", S.combined(own, {"score": 0.7, "quiet": 0.3}), S.mixed_ranks("score", "quiet"), S.rank_product({"score": 0.6, "quiet": -0.4}))
    return r6(made, ["ts_code", "trade_date"], ["combined", "mixed", "product"])


@query(BASE + ", u as (select ts_code, trade_date, score as v from scored union all select ts_code, trade_date, quiet from scored union all select ts_code, trade_date, thin from scored) select ts_code, trade_date, round(avg(v), 6) as mean_rank, count(v) as signals from u group by all")
def port_rank_sum(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the ranks that are there."""
    own = scored(spark, d)
    each = own.select("ts_code", "trade_date", F.explode(F.array("score", "quiet", "thin")).alias("v"))
    return each.groupBy("ts_code", "trade_date").agg(F.round(F.avg("v"), 6).alias("mean_rank"), F.count("v").alias("signals"))


@query(BASE + ic_sql("idx") + ", w as (select idx, spearman, count(spearman) over f as k, avg(spearman) over f as m, stddev_samp(spearman) over f as s from ic window f as (order by idx rows 23 preceding)) select idx, round(case when k = 24 and s > 1e-12 then m / s end, 6) + 0.0 as icir from w")
def port_rolling_icir(spark: SparkSession, d: str) -> DataFrame:
    f = Window.orderBy("idx").rowsBetween(-23, 0)  # one row a session
    own = S.rank_ic(scored(spark, d), ["idx"], least=MIN).withColumns({"k": F.count("spearman").over(f), "m": F.avg("spearman").over(f), "s": F.stddev_samp("spearman").over(f)})
    return own.select("idx", (F.round(F.when((F.col("k") == 24) & (F.col("s") > 1e-12), F.col("m") / F.when(F.col("s") > 0, F.col("s"))), 6) + 0.0).alias("icir"))


@query(BASE + ic_sql("trade_date") + ", s as (select avg(spearman) as m, stddev_samp(spearman) as sd, avg((spearman > 1e-9)::int) as hit from ic where spearman is not null) select round(sd / abs(m), 5) as variation, round(0.5 * least(1, abs(m) / 0.05) + 0.5 * abs(2 * hit - 1), 6) as composite, cast((abs(m) > 0.02)::int + (abs(m / sd) > 0.1)::int + (abs(hit - 0.5) > 0.05)::int as int) as passed from s")
def port_ic_stability(spark: SparkSession, d: str) -> DataFrame:
    ic = S.rank_ic(scored(spark, d), ["trade_date"], least=MIN).filter("spearman is not null")
    s = ic.agg(F.avg("spearman").alias("m"), F.stddev_samp("spearman").alias("sd"), F.avg((F.col("spearman") > 1e-9).cast("int")).alias("hit"))
    passed = (F.abs("m") > 0.02).cast("int") + (F.abs(F.col("m") / F.col("sd")) > 0.1).cast("int") + (F.abs(F.col("hit") - 0.5) > 0.05).cast("int")
    composite = 0.5 * F.least(F.lit(1.0), F.abs("m") / 0.05) + 0.5 * F.abs(2 * F.col("hit") - 1)
    return s.select(F.round(F.col("sd") / F.abs("m"), 5).alias("variation"), F.round(composite, 6).alias("composite"), passed.alias("passed"))


@query(BASE + f" select ts_code, trade_date, case when score is not null then round({quantile_sql('greatest(0.0001, least(0.9999, score))')}, 6) + 0.0 end as normal from scored")
def port_normal_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("ts_code", "trade_date", (F.round(S.normal_scores(F.col("score")), 6) + 0.0).alias("normal"))
