"""Queries of screens, scores, attributions and side channels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import day_number, instrument_code
from ..functions.normal import two_sided_sql
from ..operators import inference as I
from ..operators import models as M
from ..operators import screening as G
from ..operators import statistics as S
from ..sources.panel import dense_panel, panel_sql, sessions
from ..sources.tables import table
from .analytics import _market, _MARKET_SQL, _two_regressors, bootstrap_sql
from .problem_sql import CODE, _day
from .statistics import _PAIRS, BASE, MIN, _corr, _mean_rank_corr, ic_sql, r6, scored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _ic(spark: SparkSession, d: str) -> DataFrame:
    return S.rank_ic(scored(spark, d), ["idx", "trade_date"], least=MIN).withColumn("year", F.substring("trade_date", 1, 4))


_SCREEN = "".join(bootstrap_sql("turned", "idx", "v", b, 200, f"b{b}") for b in (10, 20, 40))


@query(BASE + ic_sql("idx, trade_date") + ", sg as (select case when avg(spearman) >= 0 then 1.0::double else -1.0::double end as s from ic), turned as (select idx, trade_date[1:4] as year, spearman * s as v from ic, sg where spearman is not null)" + _SCREEN + ", lows as (" + " union all ".join(f"select quantile_cont(mean, 0.0025) as low from b{b}" for b in (10, 20, 40)) + "), ys as (select avg((m > 0)::int) as years from (select year, avg(v) as m from turned group by 1)) select s as direction, round(min(low), 7) + 0.0 as low, round(max(years), 7) as years, min(low) > 0 and max(years) >= 0.6 as passed from lows, ys, sg group by s")
def inf_evidence_screen(spark: SparkSession, d: str) -> DataFrame:
    own = G.evidence_screen(_ic(spark, d), "idx", "spearman", "year")
    return own.select("direction", (F.round("low", 7) + 0.0).alias("low"), F.round("years", 7).alias("years"), "passed")


@query(BASE + ic_sql("trade_date") + ", ms as (select trade_date[1:6] as month, avg(spearman) as v from ic group by 1)" + bootstrap_sql("ms", "month", "v", 1, 500) + " select round(quantile_cont(mean, 0.025), 7) + 0.0 as low, round(quantile_cont(mean, 0.975), 7) + 0.0 as high, round((sum((mean <= 0)::int) + 1) / (count(mean) + 1), 7) as p from rep")
def inf_month_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean from months drawn with replacement."""
    months = _ic(spark, d).groupBy(F.substring("trade_date", 1, 6).alias("month")).agg(F.avg("spearman").alias("v"))
    own = I.bootstrap_interval(I.block_bootstrap(months, "month", "v", 1, 500))
    return own.select((F.round("low", 7) + 0.0).alias("low"), (F.round("high", 7) + 0.0).alias("high"), F.round("p", 7).alias("p"))


_BEST = I.best_by_chance(20, 0.05)


@query(_MARKET_SQL + f", a as (select avg(m) as a, count(m) as n, stddev_samp(m) as sd from market), b as (select max(a.n) as n, max(a.a / a.sd) as r, avg(pow(m - a.a, 2)) as v, avg(pow(m - a.a, 3)) as t, avg(pow(m - a.a, 4)) as f from market, a where m is not null), z as (select n, (r - {_BEST!r}::double) * sqrt(n - 1) / sqrt(1 - t / pow(v, 1.5) * r + (f / v / v - 1) / 4 * r * r) as z from b) select n, round(case when z >= 0 then 1 - {two_sided_sql('z')} / 2 else {two_sided_sql('z')} / 2 end, 7) as probability from z")
def inf_deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return I.deflated_sharpe(_market(spark, d), "m", 20, 0.05).select("n", F.round("probability", 7).alias("probability"))


@query()
def inf_overfitting(spark: SparkSession, d: str) -> DataFrame:
    """Probability that the best quantile inside is below the median outside, over balanced splits of the sessions."""
    own = S.quantile_returns(scored(spark, d), "trade_date", "score", "label", 5, 10)
    wide = own.groupBy("trade_date").pivot("quantile", [1, 2, 3, 4, 5]).agg(F.first("label")).dropna().orderBy("trade_date").toPandas()  # one row a session
    value = float(I.overfitting_probability(wide.drop(columns="trade_date").to_numpy(), 6)) if len(wide) >= 12 else None
    return spark.createDataFrame([(len(wide), value)], "sessions int, probability double")


@query(BASE + ic_sql("trade_date") + ", s as (select avg(spearman) as m, stddev_samp(spearman) as s from ic) select round(m / (s + 0.047), 6) + 0.0 as shrunk, round(ln(1 + exp(m * 10)) / 10, 6) as gate from s")
def inf_shrunk_ratio(spark: SparkSession, d: str) -> DataFrame:
    s = S.rank_ic(scored(spark, d), ["trade_date"], least=MIN).agg(F.avg("spearman").alias("m"), F.stddev_samp("spearman").alias("s"))
    return s.select((F.round(G.shrunk_ratio(F.col("m"), F.col("s")), 6) + 0.0).alias("shrunk"), F.round(G.soft_gate(F.col("m")), 6).alias("gate"))


@query(BASE + ic_sql("idx") + ", own as (select idx, spearman from ic where spearman is not null)" + bootstrap_sql("own", "idx", "spearman", 20, 500) + " select round(quantile_cont(mean / (sd + 0.047), 0.05), 6) + 0.0 as bound from rep")
def inf_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    """Lower confidence bound of the shrunk ratio over circular blocks."""
    own = _ic(spark, d).select("idx", "spearman").filter("spearman is not null")
    return I.lower_icir_bound(own, "idx", "spearman", 20).select((F.round("bound", 6) + 0.0).alias("bound"))


@query("with g as (select factor_id, avg(icir_mean) as a, avg(rank_autocorr) as b, avg(wfa_survival_rate) as c, 1 - avg(estimated_turnover) as d from factor_performance group by 1), i as (select factor_id, (least(1, abs(a)) + greatest(0, b) + c + greatest(0, d)) / 4 as x from g) select factor_id, round(x, 6) as robustness, case when round(x, 6) >= 0.6 then 'A' when round(x, 6) >= 0.4 then 'B' when round(x, 6) >= 0.25 then 'C' else 'D' end as grade from i")
def inf_robustness(spark: SparkSession, d: str) -> DataFrame:
    """Equal mean of precision, persistence, survival and slowness, graded."""
    g = table(spark, d, "factor_performance").groupBy("factor_id").agg(F.avg("icir_mean").alias("a"), F.avg("rank_autocorr").alias("b"), F.avg("wfa_survival_rate").alias("c"), (1 - F.avg("estimated_turnover")).alias("d"))
    zero = F.lit(0.0)
    x = F.round((F.least(F.lit(1.0), F.abs("a")) + F.greatest(zero, F.col("b")) + F.col("c") + F.greatest(zero, F.col("d"))) / 4, 6)
    return g.select("factor_id", x.alias("robustness"), G.grade(x).alias("grade"))


@query("with f as (select distinct experiment_id, factor_id, icir_mean from factor_performance where status <> 'fail' and abs(icir_mean) >= 0.1), n as (select experiment_id, count(*) as n from f group by 1) select experiment_id, factor_id from (select f.*, n.n, row_number() over (partition by f.experiment_id order by abs(icir_mean) desc, factor_id) as r from f join n using (experiment_id)) where r <= least(8, ceil(0.2 * n))")
def inf_seat_quota(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of an experiment's factors that pass, at most eight, by absolute ratio."""
    f = table(spark, d, "factor_performance").select("experiment_id", "factor_id", "icir_mean", "status").filter("status <> 'fail' and abs(icir_mean) >= 0.1").drop("status").distinct()
    w = Window.partitionBy("experiment_id")
    own = f.withColumns({"n": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy(F.abs("icir_mean").desc(), "factor_id"))})
    return own.filter(F.col("r") <= F.least(F.lit(8), F.ceil(F.col("n") * 0.2))).select("experiment_id", "factor_id")


@query(_MARKET_SQL + ", s as (select trade_date[1:4] as year, m from market where m is not null) select year, round(avg(m) - 0.0001, 8) + 0.0 as excess, (exp(sum(ln(1 + m))) - 1) > 0.02 as passed from s where m > -1 group by 1")
def inf_benchmark_excess(spark: SparkSession, d: str) -> DataFrame:
    """Excess over a flat benchmark of one basis point a session, and whether the year's compound return clears 2 %."""
    own = _market(spark, d).filter("m > -1").withColumn("year", F.substring("trade_date", 1, 4))
    return own.groupBy("year").agg((F.round(F.avg("m") - 0.0001, 8) + 0.0).alias("excess"), ((F.exp(F.sum(F.log1p("m"))) - 1) > 0.02).alias("passed"))


@query(_MARKET_SQL + ", e as (select min(idx) as a, max(idx) as b from market where m is not null), g as (select c.idx from cal c, e where c.idx between e.a and e.b) select g.idx, m.m from g left join market m using (idx)")
def stat_calendar_series(spark: SparkSession, d: str) -> DataFrame:
    return G.calendar_series(_market(spark, d).filter("m is not null"), sessions(spark, d), "idx", "m")


_CORR = ", c as (" + " union all ".join(_mean_rank_corr(a, b, 15) for a, b in _PAIRS) + "), w as (select coalesce(max(correlation) filter (one = 'quiet' and other = 'score'), 0) as qs, coalesce(max(correlation) filter (one = 'quiet' and other = 'thin'), 0) as qt, coalesce(max(correlation) filter (one = 'score'), 0) as st from c)"


@query(BASE + _CORR + ", d as (select *, 1 + 2 * qs * qt * st - qs * qs - qt * qt - st * st as det from w) select 'quiet' as signal, round((1 - st * st) / det, 6) as vif from d union all select 'score', round((1 - qt * qt) / det, 6) from d union all select 'thin', round((1 - qs * qs) / det, 6) from d")
def port_variance_inflation(spark: SparkSession, d: str) -> DataFrame:
    m = S.correlation_matrix(scored(spark, d), "trade_date", ["quiet", "score", "thin"], MIN).toPandas()  # k (k - 1) / 2 rows
    return spark.createDataFrame(sorted(S.variance_inflation(m.fillna(0)).items()), "signal string, vif double")


@query()
def port_risk_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of three signals' long-short returns by inverse variance, equal risk, hierarchical risk parity and softmax."""
    names, parts = ["quiet", "score", "thin"], []
    own = scored(spark, d)
    for n in names:
        q = S.quantile_returns(own, "trade_date", n, "label", 5, 10).groupBy("trade_date").agg((F.avg(F.when(F.col("quantile") == 5, F.col("label"))) - F.avg(F.when(F.col("quantile") == 1, F.col("label")))).alias(n))
        parts.append(q)
    met = parts[0].join(parts[1], "trade_date").join(parts[2], "trade_date")
    cols = [F.covar_samp(a, b).alias(f"{a}_{b}") for a in names for b in names] + [F.avg(a).alias(a) for a in names]
    r = met.agg(*cols).first()
    schema = "method string, signal string, weight double"
    if r[0] is None:
        return spark.createDataFrame([], schema)
    cov = np.array([[r[f"{a}_{b}"] for b in names] for a in names]) + 1e-12 * np.eye(3)
    out = [(m, n, round(float(w), 6)) for m, f in (("inverse_variance", S.inverse_variance), ("equal_risk", S.equal_risk), ("hierarchical", S.hierarchical_risk)) for n, w in zip(names, f(cov))]
    out += [("softmax", n, round(w, 6)) for n, w in S.softmax_top({n: r[n] for n in names}, 2, 0.001).items()]
    return spark.createDataFrame(out, schema)


@query()
def mod_shapley(spark: SparkSession, d: str) -> DataFrame:
    """Shapley values of three signals for the Sortino ratio of their combined best-fifth returns."""
    names = ["quiet", "score", "thin"]
    own = scored(spark, d).dropna(subset=[*names, "label"])
    sets = [[n for i, n in enumerate(names) if k >> i & 1] for k in range(1, 8)]
    mixed = own.select("ts_code", "trade_date", "label", *(sum((F.col(n) for n in s[1:]), F.col(s[0])).alias("+".join(s)) for s in sets))
    series = None
    for s in sets:
        name = "+".join(s)
        top = S.quantiles(mixed, "trade_date", name, 5).filter("quantile = 5").groupBy("trade_date").agg(F.avg("label").alias("r")).withColumn("set", F.lit(name))
        series = top if series is None else series.unionByName(top)
    got = {k: g["r"].to_numpy() for k, g in series.toPandas().groupby("set")}  # seven rows a session
    value = lambda s: G.sortino(np.clip(got["+".join(s)], -0.3, 0.3)) if s and "+".join(s) in got else 0.0
    return spark.createDataFrame([(n, round(v, 6)) for n, v in G.shapley(value, names).items()], "signal string, value double")


@query(BASE + _two_regressors(0.0) + ", mixed as (select trade_date, score, round(res, 8) + 0.0 as residual, round(score - res, 8) + 0.0 as explained, label from g)" + "".join(ic_sql("trade_date", source="mixed", score=part, name=f"ic_{part}") for part in ("score", "explained", "residual")) + " " + " union all ".join(f"select '{part}' as part, count(spearman) as n, round(avg(spearman), 6) + 0.0 as mean from ic_{part}" for part in ("score", "explained", "residual")))
def mod_style_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of a signal raw, of what styles explain of it, and of what is left."""
    own = scored(spark, d)
    res = M.residual_on(own, "trade_date", "score", ["quiet", "thin"]).filter("residual is not null")
    met = res.join(own.select("ts_code", "trade_date", "score", "label"), ["ts_code", "trade_date"]).withColumn("explained", F.round(F.col("score") - F.col("residual"), 8) + 0.0).withColumn("residual", F.round("residual", 8) + 0.0)
    out = None
    for part in ("score", "explained", "residual"):
        ic = S.rank_ic(met, ["trade_date"], score=part, least=MIN).agg(F.lit(part).alias("part"), F.count("spearman").alias("n"), (F.round(F.avg("spearman"), 6) + 0.0).alias("mean"))
        out = ic if out is None else out.unionByName(ic)
    return out


@query(BASE + _CORR + ", e as (select abs(qs) >= 0.3 as qs, abs(qt) >= 0.3 as qt, abs(st) >= 0.3 as st from w) select 'quiet' as signal, 'quiet' as cluster from e union all select 'score', case when qs or (st and qt) then 'quiet' else 'score' end from e union all select 'thin', case when qt or (st and qs) then 'quiet' when st then 'score' else 'thin' end from e")
def mod_signal_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Signals whose mean absolute rank correlation is high, as clusters named by their first member."""
    m = S.correlation_matrix(scored(spark, d), "trade_date", ["quiet", "score", "thin"], MIN)
    found = M.clusters(m.filter(F.abs("correlation") >= 0.3), "one", "other", ["quiet", "score", "thin"])
    return spark.createDataFrame(sorted(found.items()), "signal string, cluster string")


@query(BASE + f", g as (select trade_date, {_corr('score', 'quiet')} as a, {_corr('score', 'thin')} as b from scored where score is not null and quiet is not null and thin is not null group by 1 having count(*) >= {MIN}) select round(avg(abs(a)), 6) as with_quiet, round(avg(abs(b)), 6) as with_thin, greatest(round(avg(abs(a)), 6), round(avg(abs(b)), 6)) >= 0.7 as redundant from g")
def mod_pool_redundancy(spark: SparkSession, d: str) -> DataFrame:
    own = scored(spark, d).dropna(subset=["score", "quiet", "thin"]).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), S.correlation("score", "quiet").alias("a"), S.correlation("score", "thin").alias("b")).filter(F.col("n") >= MIN)
    return own.agg(F.round(F.avg(F.abs("a")), 6).alias("with_quiet"), F.round(F.avg(F.abs("b")), 6).alias("with_thin")).withColumn("redundant", F.greatest("with_quiet", "with_thin") >= 0.7)


# Side channels


@query(f"with v as (select {CODE} as ts_code, {_day('ann_date')} as d, div_id, cash_div from dividend where ann_date is not null and cash_div is not null) select div_id, round(avg(cash_div) over w, 6) as mean, case when count(cash_div) over w >= 2 then round(stddev_samp(cash_div) over w, 6) end as sd from v window w as (partition by ts_code order by d range between interval 364 day preceding and current row)")
def rel_rolling_days(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of announced cash over the trailing year of calendar days."""
    v = table(spark, d, "dividend").select(instrument_code("ts_code").alias("ts_code"), day_number("ann_date").alias("d"), "div_id", "cash_div").filter("d is not null and cash_div is not null")
    own = G.rolling_days(v, "ts_code", "d", "cash_div", 365, least=1)
    return own.select("div_id", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(panel_sql(["pb"]) + ", n as (select *, row_number() over (partition by ts_code order by idx) as pos, count(*) over (partition by ts_code) as n from panel), p as (select ts_code, min(case when pb is not null then (pos - 1) / n end) as f from n group by 1) select (select round(median(f), 6) from p) as first, round(avg(case when pos * 2 <= n then (pb is not null)::int end), 6) as early, round(avg(case when pos * 2 > n then (pb is not null)::int end), 6) as late, round(avg(case when pos = n then (pb is not null)::int end), 6) as last from n")
def rel_asof_coverage(spark: SparkSession, d: str) -> DataFrame:
    return r6(G.asof_coverage(dense_panel(spark, d, ["pb"]), "ts_code", "idx", "pb"), [], ["first", "early", "late", "last"])


@query(panel_sql(["pb"]) + " select ts_code, trade_date, last_value(pb ignore nulls) over (partition by ts_code order by idx rows 60 preceding) as pb, round((rank() over (partition by trade_date, pb is null order by pb) - 1) / nullif(count(pb) over (partition by trade_date) - 1, 0), 6) as place from panel")
def rel_valuation_channel(spark: SparkSession, d: str) -> DataFrame:
    """A daily ratio carried forward at most 60 sessions, and its place in the session."""
    held = Window.partitionBy("trade_date", F.col("pb").isNull())
    n = F.count("pb").over(Window.partitionBy("trade_date")) - 1
    place = (F.rank().over(held.orderBy("pb")) - 1) / F.when(n != 0, n)
    return dense_panel(spark, d, ["pb"]).select("ts_code", "trade_date", G.limited_fill("pb", "ts_code", "idx", 60).alias("pb"), F.round(place, 6).alias("place"))


@query("with g as (select user_id, cast(ts as date) as day, count(*) as flags, round(sum(value), 4) as amount from events where event_type = 'purchase' group by all), u as (select user_id, cast(min(ts) as date) as a, cast(max(ts) as date) as b from events group by 1), c as (select user_id, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as day from u) select c.user_id, strftime(c.day, '%Y%m%d') as day, coalesce(flags, 0) as flags, coalesce(amount, 0.0) as amount from c left join g using (user_id, day)")
def rel_event_flags(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums of rare events on every day from a key's first event to its last, zero where none happened."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    spans = e.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = spans.select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    g = e.filter("event_type = 'purchase'").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("flags"), F.round(F.sum("value"), 4).alias("amount"))
    return grid.join(g, ["user_id", "day"], "left").select("user_id", F.date_format("day", "yyyyMMdd").alias("day"), F.coalesce("flags", F.lit(0)).alias("flags"), F.coalesce("amount", F.lit(0.0)).alias("amount"))


@query(BASE + ", w as (select *, date_trunc('week', strptime(trade_date, '%Y%m%d'))::date + 6 as week from scored), l as (select week, max(idx) as idx from w group by 1), cut as (select week from l qualify row_number() over (order by week) > 0.7 * count(*) over ()), t as (select s.week, s.ts_code, s.label from w s join l using (week, idx) where s.score is not null and s.week in (select week from cut) qualify row_number() over (partition by s.week order by s.score desc, s.ts_code) <= 10), o as (select a.week, count(*) as n, count(b.ts_code) as kept, avg(a.label) as r from t a left join t b on b.ts_code = a.ts_code and b.week = a.week - 7 group by 1) select strftime(week, '%Y%m%d') as week, round(1 - kept / n, 6) as turnover, round(r, 6) + 0.0 as gross, round(r - (1 - kept / n) * 0.002, 6) + 0.0 as stressed from o")
def sim_weekly_out_of_sample(spark: SparkSession, d: str) -> DataFrame:
    """Best ten names of the last session of each of the last 30 % of weeks; return after doubled costs."""
    from ..operators.relational import week_end

    own = scored(spark, d).withColumn("week", week_end(F.to_date("trade_date", "yyyyMMdd")))
    weeks = own.groupBy("week").agg(F.max("idx").alias("idx"))
    place = F.row_number().over(Window.orderBy("week"))  # one row a week
    cut = weeks.withColumns({"_p": place, "_n": F.count(F.lit(1)).over(Window.partitionBy())}).filter(F.col("_p") > F.col("_n") * 0.7).select("week", "idx")
    t = own.join(cut, ["week", "idx"]).filter("score is not null")
    t = t.withColumn("r", F.row_number().over(Window.partitionBy("week").orderBy(F.col("score").desc(), "ts_code"))).filter("r <= 10")
    old = t.select(F.date_add("week", 7).alias("week"), "ts_code", F.lit(1).alias("was"))
    o = t.join(old, ["week", "ts_code"], "left").groupBy("week").agg((1 - F.count("was") / F.count(F.lit(1))).alias("t"), F.avg("label").alias("g"))
    return o.select(F.date_format("week", "yyyyMMdd").alias("week"), F.round("t", 6).alias("turnover"), (F.round("g", 6) + 0.0).alias("gross"), (F.round(F.col("g") - F.col("t") * 0.002, 6) + 0.0).alias("stressed"))


@query("select l_shipmode_ as venue, round(sum(l_extendedprice) * 0.0003 + count(*) * 5, 2) as native, round(sum(l_extendedprice) * 0.001, 2) as proxy, round((sum(l_extendedprice) * 0.001 - sum(l_extendedprice) * 0.0003 - count(*) * 5) / sum(l_extendedprice) * 1e4, 4) as gap_bps from (select l_returnflag as l_shipmode_, l_extendedprice from lineitem) group by 1")
def sim_cost_replay(spark: SparkSession, d: str) -> DataFrame:
    """A flat proxy cost against commission with a fixed fee for each trade, in basis points."""
    v, n = F.sum("l_extendedprice"), F.count(F.lit(1))
    own = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("venue"))
    return own.agg(F.round(v * 0.0003 + n * 5, 2).alias("native"), F.round(v * 0.001, 2).alias("proxy"), F.round((v * 0.001 - v * 0.0003 - n * 5) / v * 1e4, 4).alias("gap_bps"))
