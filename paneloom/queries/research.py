"""Queries of weekly columns, regimes, channels, label status, adjacent quantiles and the choice of factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import compact_date, instrument_code
from ..operators import inference as I
from ..operators import selection as C
from ..operators import statistics as S
from ..operators.relational import week_end
from ..plans.duck_backend import named
from ..plans.factors import FACTORS, c, fields_of, needs_group, turnover
from ..plans.nodes import Node, cross_rank, field, fn, mean, pct
from ..plans.spark_backend import evaluate
from ..plans.structure import skeleton
from ..session import written
from ..sources.panel import dense_panel, panel_sql
from ..sources.tables import table
from .analytics import _MARKET_SQL, _ic, _market, bootstrap_sql
from .problem_sql import CODE
from .statistics import _QR, BASE, MIN, ic_sql, lead, r6, scored, scored_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Relational


@query(panel_sql(["close"]) + " select ts_code, trade_date, close from panel where strptime(trade_date, '%Y%m%d') >= (select max(strptime(trade_date, '%Y%m%d')) from panel) - interval 90 day")
def rel_lookback_days(spark: SparkSession, d: str) -> DataFrame:
    """The last 90 calendar days of the panel: the cut is a constant by the time the panel is scanned."""
    panel = dense_panel(spark, d, ["close"])
    last = panel.agg(F.max("trade_date")).first()[0] or "19000101"
    first = F.date_format(F.date_sub(F.to_date(F.lit(last), "yyyyMMdd"), 90), "yyyyMMdd")
    return panel.filter(F.col("trade_date") >= first).select("ts_code", "trade_date", "close")


@query(f"select nc_id, {CODE} as ts_code, regexp_matches(name, 'ST|PT|退') as special from namechange where name is not null")
def rel_name_state(spark: SparkSession, d: str) -> DataFrame:
    """Whether a name marks special treatment, suspension or delisting."""
    return table(spark, d, "namechange").filter("name is not null").select("nc_id", instrument_code("ts_code").alias("ts_code"), F.col("name").rlike("ST|PT|退").alias("special"))


_WEEK = "strptime(trade_date, '%Y%m%d')"


@query(panel_sql(["high", "low", "close", "volume", "amount", "circ_mv"]) + f", w as (select ts_code, date_trunc('week', {_WEEK})::date + 6 as week, arg_max(close, idx) filter (close is not null) as close, max(high) as h, min(low) as l, sum(volume) as v, sum(amount) as a, arg_max(circ_mv, idx) filter (circ_mv is not null) as size from panel group by all), r as (select *, close / nullif(lag(close) over k, 0) - 1 as ret, lag(close, 52) over k as old from w window k as (partition by ts_code order by week)) select ts_code, strftime(week, '%Y%m%d') as week, round(ret, 6) + 0.0 as ret, round(case when v <> 0 then a * 10 / v end, 6) as vwap, round(case when l <> 0 then h / l end, 6) as hl_ratio, round(close / nullif(old, 0) - 1, 6) + 0.0 as momentum_12_1, round(case when count(ret) over k >= 6 then stddev_samp(ret) over k end, 6) as vol_60, round(case when size > 0 then ln(size) end, 6) as log_size from r window k as (partition by ts_code order by week rows 11 preceding)")
def rel_weekly_derived(spark: SparkSession, d: str) -> DataFrame:
    """Columns derived from weekly bars: return, traded price, range, 52-week change, 12-week deviation of returns, size."""
    p = dense_panel(spark, d, ["high", "low", "close", "volume", "amount", "circ_mv"]).withColumn("week", week_end(F.to_date("trade_date", "yyyyMMdd")))
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("idx")))
    w = p.groupBy("ts_code", "week").agg(last("close").alias("close"), F.max("high").alias("h"), F.min("low").alias("l"), F.sum("volume").alias("v"), F.sum("amount").alias("a"), last("circ_mv").alias("size"))
    k = Window.partitionBy("ts_code").orderBy("week")
    f = k.rowsBetween(-11, 0)
    over = lambda a, b: a / F.when(b != 0, b)
    r = w.withColumns({"ret": over(F.col("close"), F.lag("close").over(k)) - 1, "old": F.lag("close", 52).over(k)})
    vol = F.when(F.count("ret").over(f) >= 6, F.stddev_samp("ret").over(f))
    made = {"ret": F.col("ret"), "vwap": over(F.col("a") * 10, F.col("v")), "hl_ratio": over(F.col("h"), F.col("l")), "momentum_12_1": over(F.col("close"), F.col("old")) - 1, "vol_60": vol, "log_size": F.when(F.col("size") > 0, F.ln("size"))}
    return r.select("ts_code", F.date_format("week", "yyyyMMdd").alias("week"), *((F.round(v, 6) + 0.0).alias(n) for n, v in made.items()))


@query(panel_sql(["close", "up_limit"]) + ", u as (select *, coalesce(close >= up_limit * 0.999, false) as up from panel), g as (select *, sum((not up)::int) over (partition by ts_code order by idx) as g from u) select ts_code, trade_date, cast(case when up then row_number() over (partition by ts_code, g order by idx) - case when g > 0 then 1 else 0 end else 0 end as int) as run, idx - last_value(case when up then idx end ignore nulls) over (partition by ts_code order by idx rows unbounded preceding) as since from g")
def rel_limit_runs(spark: SparkSession, d: str) -> DataFrame:
    """Sessions in a row at the upper limit, and sessions since the last one there."""
    w = Window.partitionBy("ts_code").orderBy("idx")
    u = dense_panel(spark, d, ["close", "up_limit"]).withColumn("up", F.coalesce(F.col("close") >= F.col("up_limit") * 0.999, F.lit(False)))
    last_down = F.last(F.when(~F.col("up"), F.col("idx")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("idx").over(Window.partitionBy("ts_code")) - 1
    run = F.when(F.col("up"), F.col("idx") - F.coalesce(last_down, first)).otherwise(0)
    since = F.col("idx") - F.last(F.when(F.col("up"), F.col("idx")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return u.select("ts_code", "trade_date", run.cast("int").alias("run"), since.alias("since"))


_DIVIDENDS = f"v as (select distinct {CODE} as ts_code, replace(trim(ex_date), '-', '') as trade_date, cash_div from dividend where cash_div is not null), s as (select ts_code, trade_date, sum(cash_div) as cash from v group by all)"


@query(panel_sql(["close"]) + f", {_DIVIDENDS}, m as (select p.*, coalesce(s.cash, 0) as cash from panel p left join s using (ts_code, trade_date)) select ts_code, trade_date, round(sum(cash) over w, 6) as cash_250, round(case when close > 0 then round(sum(cash) over w, 6) / close end, 7) as yield from m window w as (partition by ts_code order by idx rows 249 preceding)")
def rel_dividend_sum(spark: SparkSession, d: str) -> DataFrame:
    """Cash of distinct dividends by their ex sessions, summed over 250 sessions, and what that is of the price."""
    v = table(spark, d, "dividend").filter("cash_div is not null").select(instrument_code("ts_code").alias("ts_code"), compact_date("ex_date").alias("trade_date"), "cash_div").distinct()
    s = v.groupBy("ts_code", "trade_date").agg(F.sum("cash_div").alias("cash"))
    m = dense_panel(spark, d, ["close"]).join(s, ["ts_code", "trade_date"], "left").withColumn("cash", F.coalesce("cash", F.lit(0.0)))
    total = F.sum("cash").over(Window.partitionBy("ts_code").orderBy("idx").rowsBetween(-249, 0))
    return m.select("ts_code", "trade_date", F.round(total, 6).alias("cash_250"), F.round(F.when(F.col("close") > 0, F.round(total, 6) / F.col("close")), 7).alias("yield"))


# Labels


@query(panel_sql(["open", "close", "adj"]) + ", x as (select *, lead(open) over k as entry, lead(close, 2) over k as out, count(*) over f as bars, count(adj) over f as known, min(adj) over f as lo, max(adj) over f as hi from panel window k as (partition by ts_code order by idx), f as (partition by ts_code order by idx rows between current row and 2 following)), s as (select *, case when bars < 3 then 'tail' when known < 3 then 'unknown' when lo <> hi then 'action' when entry is null or out is null or entry = 0 then 'no_price' else 'mature' end as status from x) select ts_code, trade_date, status, case when status = 'mature' then idx + 2 end as mature_at, round(case when status = 'mature' then out / entry - 1 end, 8) + 0.0 as label from s")
def stat_label_status(spark: SparkSession, d: str) -> DataFrame:
    """Entry at the next open, exit at the close after it, with a status: only where the adjustment factor is known and the same on all
    bars in between is there a label, and it is known from ``mature_at`` on."""
    w = Window.partitionBy("ts_code").orderBy("idx")
    f = w.rowsBetween(0, 2)
    x = dense_panel(spark, d, ["open", "close", "adj"]).withColumns({"entry": F.lead("open").over(w), "out": F.lead("close", 2).over(w), "bars": F.count(F.lit(1)).over(f), "known": F.count("adj").over(f), "lo": F.min("adj").over(f), "hi": F.max("adj").over(f)})
    priced = F.col("entry").isNotNull() & F.col("out").isNotNull() & (F.col("entry") != 0)
    status = F.when(F.col("bars") < 3, "tail").when(F.col("known") < 3, "unknown").when(F.col("lo") != F.col("hi"), "action").when(~priced, "no_price").otherwise("mature")
    x = x.withColumn("status", status)
    ripe = F.col("status") == "mature"
    return x.select("ts_code", "trade_date", "status", F.when(ripe, F.col("idx") + 2).alias("mature_at"), (F.round(F.when(ripe, F.col("out") / F.when(F.col("entry") != 0, F.col("entry")) - 1), 8) + 0.0).alias("label"))


# Inference


_DELTAS = ", w as (select trade_date, " + ", ".join(f"max(label) filter (quantile = {k}) as q{k}" for k in range(1, 6)) + " from qr group by 1), dl as (select trade_date, " + ", ".join(f"q{k + 1} - q{k} as d{k}" for k in range(1, 5)) + " from w)"


@query(BASE + _QR + _DELTAS + "".join(bootstrap_sql("dl", "trade_date", f"d{k}", 20, 300, f"b{k}") for k in range(1, 5)) + " " + " union all ".join(f"select {k} as step, (select round(avg(d{k}), 7) + 0.0 from dl) as mean, round(quantile_cont(mean, 0.0125), 7) + 0.0 as lower from b{k}" for k in range(1, 5)))
def port_adjacent_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Differences of neighbouring quantiles' returns, each with a lower bound at a level shared among the four (Bonferroni)."""
    q = S.quantile_returns(scored(spark, d), "trade_date", "score", "label", 5, 10)
    wide = q.groupBy("trade_date").agg(*(F.max(F.when(F.col("quantile") == k, F.col("label"))).alias(f"q{k}") for k in range(1, 6)))
    deltas = written(wide.select("trade_date", *((F.col(f"q{k + 1}") - F.col(f"q{k}")).alias(f"d{k}") for k in range(1, 5))))
    out = None
    for k in range(1, 5):
        low = I.block_bootstrap(deltas, "trade_date", f"d{k}", 20, 300).agg(F.percentile("mean", F.lit(0.05 / 4)).alias("lower"))
        part = deltas.agg(F.avg(f"d{k}").alias("mean"), F.lit(k).alias("step")).join(low.withColumn("step", F.lit(k)), "step")
        part = part.select("step", (F.round("mean", 7) + 0.0).alias("mean"), (F.round("lower", 7) + 0.0).alias("lower"))
        out = part if out is None else out.unionByName(part)
    return out


def _hac(lags: int) -> str:
    terms = "".join(f" + 2 * (1 - {k} / {lags + 1}.0) * coalesce(sum(e * l{k}), 0) / count(*)" for k in range(1, lags + 1))
    return f"select {lags} as lags, count(*) as n, round((sum(e * e) / count(*){terms}) / count(*) * 1e4, 6) as variance_e4 from l"


@query(BASE + ic_sql("idx") + ", e as (select idx, spearman - avg(spearman) over () as e from ic where spearman is not null), l as (select *, " + ", ".join(f"lag(e, {k}) over (order by idx) as l{k}" for k in range(1, 24)) + " from e) " + " union all ".join(_hac(k) for k in (5, 11, 23)))
def inf_hac_grid(spark: SparkSession, d: str) -> DataFrame:
    """Long-run variance of the mean at three lag lengths, for planning."""
    ic, out = written(_ic(spark, d)), None
    for lags in (5, 11, 23):
        part = I.hac_variance(ic, "idx", "spearman", lags).select(F.lit(lags).alias("lags"), "n", F.round(F.col("variance") * 1e4, 6).alias("variance_e4"))
        out = part if out is None else out.unionByName(part)
    return out


@query(_MARKET_SQL + ", w as (select *, trade_date[1:4] as year, sum(ln(1 + m)) over (partition by trade_date[1:4] order by idx) as w from market where m > -1), p as (select *, greatest(max(w) over (partition by year order by idx), 0) as p from w), g as (select year, count(*) as n, exp(sum(ln(1 + m))) - 1 as total, max(1 - exp(w - p)) as drawdown from p group by 1), y as (select total - 0.02 as excess, case when drawdown > 0 then (pow(1 + total, 252 / n) - 1) / drawdown end as calmar from g) select count(*) as years, round(min(excess), 6) + 0.0 as least_excess, round(min(calmar), 5) + 0.0 as least_calmar, min(excess) > 0 and min(calmar) > 0.5 as passed from y")
def inf_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Passed only if every year's excess over 2 % is positive and every year's Calmar ratio exceeds a half."""
    y = I.performance(_market(spark, d).withColumn("year", F.substring("trade_date", 1, 4)), "idx", "m", ["year"])
    own = y.agg(F.count(F.lit(1)).alias("years"), F.min(F.col("total") - 0.02).alias("e"), F.min("calmar").alias("c"))
    return own.select("years", (F.round("e", 6) + 0.0).alias("least_excess"), (F.round("c", 5) + 0.0).alias("least_calmar"), ((F.col("e") > 0) & (F.col("c") > 0.5)).alias("passed"))


# Regimes


_STYLE = {"r": fn("clip", pct(c), par=(-0.3, 0.3)), "place": fn("xrank", fn("lag", field("circ_mv"), par=(1,)))}


@query(panel_sql(["close", "circ_mv"]) + named("st", "panel", _STYLE, ["ts_code", "idx"], digits=8) + ", s as (select idx, avg(r) as m, avg(r) filter (place <= 0.5) - avg(r) filter (place > 0.5) as style from st group by 1), x as (select idx, count(m) over f as n, exp(sum(ln(1 + m)) over f) - 1 as trend, stddev_samp(m) over f as vol, sum(style) over f as style from s window f as (order by idx rows 19 preceding)), v as (select *, median(vol) over (order by idx) as usual from (select * from x where n = 20)) select idx, case when trend > 0 then 'up' else 'down' end as trend, case when vol > usual then 'wild' else 'calm' end as volatility, case when style > 0 then 'small' when style <= 0 then 'large' end as style from v")
def mod_regime_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Four-week regimes: compound return, deviation against its median so far, small against large names."""
    s = evaluate(dense_panel(spark, d, ["close", "circ_mv"]), _STYLE).select("idx", *(F.round(x, 8).alias(x) for x in _STYLE))
    small = F.col("place") <= 0.5
    s = s.groupBy("idx").agg(F.avg("r").alias("m"), (F.avg(F.when(small, F.col("r"))) - F.avg(F.when(F.col("place") > 0.5, F.col("r")))).alias("style"))
    f = Window.orderBy("idx").rowsBetween(-19, 0)  # one row a session
    x = s.select("idx", F.count("m").over(f).alias("n"), (F.exp(F.sum(F.log1p("m")).over(f)) - 1).alias("trend"), F.stddev_samp("m").over(f).alias("vol"), F.sum("style").over(f).alias("style")).filter("n = 20")
    usual = F.percentile("vol", F.lit(0.5)).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("idx", F.when(F.col("trend") > 0, "up").otherwise("down").alias("trend"), F.when(F.col("vol") > usual, "wild").otherwise("calm").alias("volatility"), F.when(F.col("style") > 0, "small").when(F.col("style") <= 0, "large").alias("style"))


# Choosing factors


def ablated(node: Node, name: str) -> Node:
    """The expression with a field replaced by its session's mean, which tells instruments apart no more."""
    if node == field(name):
        return fn("xmean", node)
    return Node(node.op, tuple(ablated(a, name) for a in node.args), node.par)


_WHOLE = cross_rank(mean(turnover, 5)) * 0.5 - cross_rank(pct(c, 5))
_ABLATION = {"whole": _WHOLE} | {f"without_{f}": ablated(_WHOLE, f) for f in fields_of(_WHOLE)}


@query(scored_sql(_ABLATION) + "".join(ic_sql("trade_date", score=n, name=f"ic_{n}") for n in _ABLATION) + " " + " union all ".join(f"select '{n}' as channel, count(spearman) as n, round(avg(spearman), 6) + 0.0 as mean from ic_{n}" for n in _ABLATION))
def mod_channel_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of an expression, and of it with each of its fields silenced in turn."""
    own, out = scored(spark, d, _ABLATION), None
    for n in _ABLATION:
        part = S.rank_ic(own, ["trade_date"], score=n, least=MIN).agg(F.count("spearman").alias("n"), (F.round(F.avg("spearman"), 6) + 0.0).alias("mean")).select(F.lit(n).alias("channel"), "n", "mean")
        out = part if out is None else out.unionByName(part)
    return out


_POOL = ("short_rev_5d", "vol_1m")
_CANDIDATES = ("ret_1m", "roc_20", "turnover_cv_20d", "amihud_illiq", "high_low_range", "max_ret_1m", "volume_ratio", "psy_12")


def _library(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Ranks of some library factors and the next return, as a written table."""
    names = sorted({*_POOL, *_CANDIDATES})
    signals = {n: FACTORS[n][1] for n in names} | {"label": lead(c, 1) / c - 1}
    fields = sorted({f for x in signals.values() for f in fields_of(x)})
    panel = evaluate(dense_panel(spark, d, fields, any(needs_group(x) for x in signals.values())), signals)
    return written(panel.select("ts_code", "trade_date", "idx", *((F.round(n, 8) + 0.0).alias(n) for n in signals))), names


def _ics(own: DataFrame, names: list[str]) -> DataFrame:
    out = None
    for n in names:
        part = S.rank_ic(own, ["idx"], score=n, least=MIN).select(F.lit(n).alias("factor"), "idx", F.col("spearman").alias("ic"))
        out = part if out is None else out.unionByName(part)
    return out.filter("ic is not null")


@query()
def mod_validation_stages(spark: SparkSession, d: str) -> DataFrame:
    """Eight candidates against a pool of two, through six stages."""
    own, names = _library(spark, d)
    found = C.validated(_ics(own, names), C.correlations(own, "trade_date", names, MIN), names, list(_POOL), {n: skeleton(FACTORS[n][1]) for n in names})
    return spark.createDataFrame([(n, s, round(m, 6), round(p, 6)) for n, (s, m, p) in sorted(found.items())], "factor string, stage string, mean double, p double")


@query()
def mod_three_stage_screen(spark: SparkSession, d: str) -> DataFrame:
    """Strength, best of each Ward cluster, sign over walk-forward windows of 60 sessions."""
    own, names = _library(spark, d)
    ic = written(_ics(own, names))
    total = {r[0]: (r[1] / r[2] if r[2] else 0.0) for r in ic.groupBy("factor").agg(F.avg("ic"), F.stddev_samp("ic")).collect()}  # k rows
    parts = ic.groupBy("factor", F.floor(F.col("idx") / 60).alias("w")).agg(F.avg("ic").alias("m")).orderBy("factor", "w").collect()  # one row a factor and window
    windows = {n: [r["m"] for r in parts if r["factor"] == n] for n in names}
    found = C.three_stage_screen({n: total.get(n, 0.0) for n in names}, C.correlations(own, "trade_date", names, MIN), windows)
    return spark.createDataFrame(sorted(found.items()), "factor string, outcome string")


@query()
def mod_factor_stack(spark: SparkSession, d: str) -> DataFrame:
    """Factors whose joint regression on the next return has the least BIC, by beam search over one matrix of correlations."""
    own, names = _library(spark, d)
    whole = own.select(*names, F.greatest(F.lit(-0.3), F.least(F.lit(0.3), "label")).alias("label")).dropna()
    columns = [*names, "label"]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = whole.agg(F.count(F.lit(1)).alias("n"), *(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs)).first()
    if r["n"] < 30:
        return spark.createDataFrame([], "factor string, bic double")
    m = np.eye(len(columns))
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = r[f"{a}|{b}"] or 0.0
    chosen, bic = C.beam_stack(m[:-1, :-1], m[:-1, -1], r["n"])
    return spark.createDataFrame([(names[i], round(bic, 4)) for i in chosen], "factor string, bic double")
