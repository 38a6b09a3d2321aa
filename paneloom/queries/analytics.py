"""Queries of inference, neutralisation, models, regimes, crowding, signals and simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import compact_date, instrument_code
from ..functions.normal import two_sided, two_sided_sql
from ..operators import inference as I
from ..operators import models as M
from ..operators import simulation as X
from ..operators import statistics as S
from ..plans.duck_backend import named
from ..plans.factors import FACTORS, c, h, l, o, r
from ..plans.formula import parse
from ..plans.indicators import signals
from ..plans.nodes import Node, absolute, fill, fn, lag, mean, pct, smaller, std, where
from ..plans.spark_backend import evaluate
from ..plans.structure import library, near_duplicates
from ..session import written
from ..sources.panel import dense_panel, panel_sql, sessions
from ..sources.tables import table
from .factors import KEYS, panel_query
from .statistics import BASE, MIN, ic_sql, r6, scored, scored_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Signals: 22 of 23 are expressions

for _name, (_buy, _sell) in signals().items():
    QUERIES[f"sig_{_name}"], SQL[f"sig_{_name}"] = panel_query({"buy": _buy, "sell": _sell})


@query()
def sig_sar(spark: SparkSession, d: str) -> DataFrame:
    return X.parabolic_stop(dense_panel(spark, d, ["high", "low", "close"]))


# Inference


def _ic(spark: SparkSession, d: str) -> DataFrame:
    return S.rank_ic(scored(spark, d), ["idx"], least=MIN)


def _p_values(spark: SparkSession, d: str) -> DataFrame:
    """One test a month: the two-sided normal p-value of its t statistic."""
    own = S.rank_ic(scored(spark, d), ["trade_date"], least=MIN).withColumn("month", F.substring("trade_date", 1, 6))
    t = S.describe(own, "spearman", ["month"])
    return t.select("month", F.round(two_sided(F.col("t")), 8).alias("p"))


_P = BASE + ic_sql("trade_date") + ", m as (select trade_date[1:6] as month, avg(spearman) as a, stddev_samp(spearman) as s, count(spearman) as n from ic where spearman is not null group by 1), ts as (select month, case when s > 1e-12 then a / s end * sqrt(n) as z from m), tests as (select month, round(" + two_sided_sql("z") + ", 8) as p from ts)"


@query(_P + ", a as (select month, p, least(1.0, (count(*) over () - row_number() over (order by p, month) + 1) * p) as s from tests where p is not null) select month, p, round(max(s) over (order by p, month), 8) as holm from a")
def inf_holm(spark: SparkSession, d: str) -> DataFrame:
    return I.holm(_p_values(spark, d), "month", "p").select("month", "p", F.round("holm", 8).alias("holm"))


@query(_P + ", a as (select month, p, least(1.0, count(*) over () / row_number() over (order by p, month) * p) as s from tests where p is not null) select month, p, round(min(s) over (order by p desc, month desc), 8) as bh from a")
def inf_benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    return I.benjamini_hochberg(_p_values(spark, d), "month", "p").select("month", "p", F.round("bh", 8).alias("bh"))


@query(BASE + ic_sql("idx") + ", e as (select idx, spearman - avg(spearman) over () as e, spearman from ic where spearman is not null), l as (select *, " + ", ".join(f"lag(e, {k}) over (order by idx) as l{k}" for k in range(1, 6)) + " from e) select count(*) as n, round(avg(spearman), 6) + 0.0 as mean, round((sum(e * e) / count(*) + " + " + ".join(f"2 * (1 - {k} / 6.0) * sum(e * l{k}) / count(*)" for k in range(1, 6)) + ") / count(*) * 1e4, 6) as variance_e4 from l")
def inf_hac(spark: SparkSession, d: str) -> DataFrame:
    own = I.hac_variance(_ic(spark, d), "idx", "spearman", 5)
    return own.select("n", (F.round("mean", 6) + 0.0).alias("mean"), F.round(F.col("variance") * 1e4, 6).alias("variance_e4"))


def bootstrap_sql(source: str, order: str, value: str, block: int, replicates: int, name: str = "rep", seed: int = 7) -> str:
    """``, {name} as (replicate, mean, sd)`` with the draws of :func:`block_bootstrap`, summed value by value."""
    return f""", {name}_v as (select cast({value} as double) as v, row_number() over (order by {order}) - 1 as p, count(*) over () as n from {source}),
{name}_n as (select max(n) as n, least(max(n), {block}) as b from {name}_v),
{name}_d as (select r, j, n, b, cast('0x' || substr(md5('{seed}|' || r || '|' || j), 1, 8) as bigint) % n as a, case when j < ceil(n / b) - 1 then b else n - b * (ceil(n / b) - 1) end as size
  from {name}_n, range(0, {replicates}) x(r), range(0, 4096) y(j) where j < ceil(n / b)),
{name}_e as (select r, (a + unnest(range(0, cast(size as bigint)))) % n as p from {name}_d),
{name} as (select e.r as replicate, avg(v) as mean, stddev_samp(v) as sd from {name}_e e join {name}_v using (p) group by 1)"""


@query(BASE + ic_sql("idx") + bootstrap_sql("ic", "idx", "spearman", 20, 500) + " select round(quantile_cont(mean, 0.025), 7) + 0.0 as low, round(quantile_cont(mean, 0.975), 7) + 0.0 as high, round((sum((mean <= 0)::int) + 1) / (count(mean) + 1), 7) as p from rep")
def inf_block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    own = I.bootstrap_interval(I.block_bootstrap(_ic(spark, d), "idx", "spearman", block=20, replicates=500))
    return own.select((F.round("low", 7) + 0.0).alias("low"), (F.round("high", 7) + 0.0).alias("high"), F.round("p", 7).alias("p"))


_MARKET = {"m": fn("xmean", fn("clip", r, par=(-0.3, 0.3)))}


def _market(spark: SparkSession, d: str) -> DataFrame:
    own = evaluate(dense_panel(spark, d, ["close"]), _MARKET)
    return own.groupBy("idx", "trade_date").agg(F.round(F.max("m"), 8).alias("m"))


_MARKET_SQL = panel_sql(["close"]) + named("mk", "panel", _MARKET, ["ts_code", "idx", "trade_date"], digits=8) + ", market as (select idx, trade_date, max(m) as m from mk group by all)"


@query(_MARKET_SQL + ", w as (select *, trade_date[1:4] as year, sum(ln(1 + m)) over (partition by trade_date[1:4] order by idx) as w from market where m > -1), p as (select *, greatest(max(w) over (partition by year order by idx), 0) as p from w), g as (select year, count(*) as n, exp(sum(ln(1 + m))) - 1 as total, max(1 - exp(w - p)) as drawdown, avg(m) as mean, stddev_samp(m) as sd from p group by 1) select year, n, round(total, 6) as total, round(drawdown, 6) as drawdown, round(mean, 6) + 0.0 as mean, round(sd, 6) as sd, round(mean / sd * sqrt(252), 6) + 0.0 as sharpe, round((pow(1 + total, 252 / n) - 1) / drawdown, 5) + 0.0 as calmar from g")
def inf_performance(spark: SparkSession, d: str) -> DataFrame:
    own = _market(spark, d).withColumn("year", F.substring("trade_date", 1, 4))
    p = I.performance(own, "idx", "m", ["year"])
    return p.select("year", "n", *(F.round(x, 6).alias(x) for x in ("total", "drawdown")), (F.round("mean", 6) + 0.0).alias("mean"), F.round("sd", 6).alias("sd"), (F.round("sharpe", 6) + 0.0).alias("sharpe"), (F.round("calmar", 5) + 0.0).alias("calmar"))


@query("with c as (select row_number() over (order by cal_date) as idx from trade_cal where is_open = 1), e as (select min(idx) as a, max(idx) as b from c), s as (select a, unnest(range(a, b - 250 - 5 - 60 + 2, 60)) as s from e) select cast((s - a) // 60 as int) as fold, cast(s as int) as train_from, cast(s + 249 as int) as train_to, cast(s + 255 as int) as test_from, cast(s + 314 as int) as test_to from s")
def inf_walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    return I.folds(sessions(spark, d), "idx", 250, 60, 60, embargo=5)


@query("with c as (select cast(row_number() over (order by cal_date) as int) as idx from trade_cal where is_open = 1) select idx, cast((idx // 20) % 5 as int) as fold from c")
def inf_k_folds(spark: SparkSession, d: str) -> DataFrame:
    return sessions(spark, d).select("idx", I.k_fold(F.col("idx"), 5, 20).alias("fold"))


@query("with f as (select experiment_id, factor_id, max(round(icir_mean, 6)) as a, max(round(wfa_survival_rate, 6)) as b from factor_performance group by all) select x.experiment_id, x.factor_id, x.a, x.b from f x where a is not null and b is not null and not exists (select 1 from f y where y.a >= x.a and y.b >= x.b and (y.a > x.a or y.b > x.b))")
def inf_pareto(spark: SparkSession, d: str) -> DataFrame:
    """Factors that none beats in both information ratio and survival."""
    f = table(spark, d, "factor_performance").groupBy("experiment_id", "factor_id").agg(F.max(F.round("icir_mean", 6)).alias("a"), F.max(F.round("wfa_survival_rate", 6)).alias("b"))
    return I.pareto(f, "factor_id", ["a", "b"])


@query("with g as (select experiment_id, lower(trim(category)) as category, count(*) as n from factor_performance group by all) select experiment_id, round(sum(n * n) / cast(sum(n) * sum(n) as double), 6) as hhi from g group by 1")
def inf_diversity(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "factor_performance").select("experiment_id", F.lower(F.trim("category")).alias("category"), F.lit(1.0).alias("one"))
    return I.concentration(own, ["experiment_id"], "category", "one").select("experiment_id", F.round("hhi", 6).alias("hhi"))


@query("with g as (select factor_id, cast(sum(passed_screening) as double) as h, cast(count(passed_screening) as double) as n from factor_performance group by 1) select factor_id, round((h / n + 3.8416 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) + 0.0 as lower from g where n > 0")
def inf_wilson(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "factor_performance").groupBy("factor_id").agg(F.sum("passed_screening").cast("double").alias("h"), F.count("passed_screening").cast("double").alias("n")).filter("n > 0")
    return own.select("factor_id", (F.round(I.wilson_lower(F.col("h"), F.col("n")), 6) + 0.0).alias("lower"))


@query("with q as (select quantile_cont(icir_mean, 0.5) as a, quantile_cont(icir_mean, 0.95) as b from factor_performance where status = 'fail') select factor_id, round(max(icir_mean), 6) as best, round(max(percent), 6) as percentile from (select factor_id, icir_mean, percent_rank() over (order by icir_mean) as percent from factor_performance where icir_mean is not null) group by 1")
def inf_null_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Where each factor's best ratio lies among all."""
    own = table(spark, d, "factor_performance").filter("icir_mean is not null")
    own = own.withColumn("p", F.percent_rank().over(Window.orderBy("icir_mean")))
    return own.groupBy("factor_id").agg(F.round(F.max("icir_mean"), 6).alias("best"), F.round(F.max("p"), 6).alias("percentile"))


@query("select q, round(quantile_cont(value, q), 6) as value from events, (values (0.05), (0.5), (0.95)) t(q) group by q".replace("quantile_cont(value, q)", "case q when 0.05 then quantile_cont(value, 0.05) when 0.5 then quantile_cont(value, 0.5) else quantile_cont(value, 0.95) end").replace("select q,", "select cast(q as double) as q,"))
def inf_quantiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    own = e.agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("v"))
    return own.select(F.explode(F.arrays_zip(F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)).alias("q"), F.col("v").alias("value"))).alias("e")).select(F.col("e.q").alias("q"), F.round("e.value", 6).alias("value"))


# Neutralisation and redundancy

_CAP = {"cap": fn("log", fn("field", par=("circ_mv",)))}


@query(scored_sql(_CAP) + ", f as (select *, case when score is not null and cap is not null and industry is not null then score end as y, case when score is not null and cap is not null and industry is not null then cap end as x from scored), g as (select *, y - avg(y) over k as dy, x - avg(x) over k as dx from f window k as (partition by trade_date, industry)) select ts_code, trade_date, round(dy - case when sum(dx * dx) over t > 1e-12 then sum(dx * dy) over t / sum(dx * dx) over t else 0 end * dx, 6) + 0.0 as residual from g window t as (partition by trade_date)")
def mod_neutralised(spark: SparkSession, d: str) -> DataFrame:
    own = M.neutralised(scored(spark, d, _CAP), "trade_date", "industry", "score", "cap")
    return r6(own, KEYS, ["residual"])


def _one_regressor(y: str, x: str) -> str:
    return f"f as (select ts_code, trade_date, {y} as y, ({x} - avg({x}) over d) as dx, ({y} - avg({y}) over d) as dy, count(*) over d as n from scored where {y} is not null and {x} is not null window d as (partition by trade_date)), g as (select *, sum(dx * dx) over d as sxx, sum(dx * dy) over d as sxy, sum(dy * dy) over d as syy from f where n >= 10 window d as (partition by trade_date))"


@query(BASE + ", " + _one_regressor("score", "quiet") + " select ts_code, trade_date, round(dy - case when sxx > 1e-12 then sxy / sxx else 0 end * dx, 6) + 0.0 as residual, round(case when syy > 1e-12 then case when sxx > 1e-12 then sxy * sxy / sxx / syy else 0 end end, 6) + 0.0 as r2 from g")
def mod_residual(spark: SparkSession, d: str) -> DataFrame:
    """Residual of one signal on another by session (least squares)."""
    own = M.residual_on(scored(spark, d), "trade_date", "score", ["quiet"]).filter("residual is not null")
    return r6(own, KEYS, ["residual", "r2"])


def _two_regressors(ridge: float, target: str = "score", name: str = "") -> str:
    """``, {name}g as (ts_code, trade_date, score, label, res, r2)``: score on quiet and thin, both standardised by session."""
    z = lambda x: f"({x} - avg({x}) over d) / case when stddev_pop({x}) over d > 1e-12 then stddev_pop({x}) over d else 1 end"
    return f""", {name}f as (select ts_code, trade_date, score, label, {target} - avg({target}) over d as t, {z("quiet")} as x, {z("thin")} as y, count(*) over d as n from scored where {target} is not null and quiet is not null and thin is not null window d as (partition by trade_date)),
{name}m as (select *, sum(x * x) over d + {ridge} * n as xx, sum(y * y) over d + {ridge} * n as yy, sum(x * y) over d as xy, sum(x * t) over d as xt, sum(y * t) over d as yt from {name}f where n >= 10 window d as (partition by trade_date)),
{name}w as (select *, t - ((xt * yy - yt * xy) * x + (yt * xx - xt * xy) * y) / (xx * yy - xy * xy) as res from {name}m),
{name}g as (select *, case when sum(t * t) over d > 0 then 1 - sum(res * res) over d / sum(t * t) over d end as r2 from {name}w window d as (partition by trade_date))"""


@query(BASE + _two_regressors(0.1) + " select ts_code, trade_date, round(res, 6) + 0.0 as residual, round(r2, 6) + 0.0 as r2 from g")
def mod_ridge_residual(spark: SparkSession, d: str) -> DataFrame:
    own = M.residual_on(scored(spark, d), "trade_date", "score", ["quiet", "thin"], ridge=0.1).filter("residual is not null")
    return r6(own, KEYS, ["residual", "r2"])


@query(BASE + ", " + _one_regressor("score", "quiet") + f", e as (select ts_code, trade_date, dy - case when sxx > 1e-12 then sxy / sxx else 0 end * dx as res from g), m as (select trade_date, round(res, 8) + 0.0 as score, label from e join (select ts_code, trade_date, label from scored) using (ts_code, trade_date))" + ic_sql("trade_date", source="m") + " select count(spearman) as n, round(avg(spearman), 6) + 0.0 as mean from ic")
def mod_residual_ic(spark: SparkSession, d: str) -> DataFrame:
    """What a signal still says once another one is taken out of it."""
    own = scored(spark, d)
    res = M.residual_on(own, "trade_date", "score", ["quiet"]).filter("residual is not null")
    met = res.join(own.select("ts_code", "trade_date", "label"), KEYS).select("trade_date", (F.round("residual", 8) + 0.0).alias("score"), "label")
    return S.rank_ic(met, ["trade_date"], least=MIN).agg(F.count("spearman").alias("n"), (F.round(F.avg("spearman"), 6) + 0.0).alias("mean"))


@query(BASE + _two_regressors(0.0, "label", "a") + _two_regressors(0.0, "score", "b") + ", s as (select count(*) as n, sum(a.res * b.res) as ab, sum(b.res * b.res) as bb, sum(a.res * a.res) as aa from ag a join bg b using (ts_code, trade_date)) select n, round(ab / bb, 7) + 0.0 as effect, round(ab / bb / sqrt((aa - ab * ab / bb) / (n - 2) / bb), 5) + 0.0 as t from s")
def mod_double_ml(spark: SparkSession, d: str) -> DataFrame:
    own = M.double_ml(scored(spark, d), "trade_date", "label", "score", ["quiet", "thin"])
    return own.select("n", (F.round("effect", 7) + 0.0).alias("effect"), (F.round("t", 5) + 0.0).alias("t"))


@query()
def mod_ridge_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    own = scored(spark, d)
    made = M.walk_forward_ridge(own, "idx", ["score", "quiet", "thin"], "label", train=200, embargo=5, every=40)
    return made.select("ts_code", "idx", F.round("prediction", 6).alias("prediction"))


@query()
def mod_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of boosted trees that are fitted again every 20 sessions on all sessions that end five before."""
    xs = ["score", "quiet", "thin"]
    own = written(scored(spark, d).select("ts_code", "idx", *xs, "label"))
    made = M.walk_forward_trees(own, "idx", xs, "label", train=40, embargo=5, every=20, trees=40)
    out = made.join(own.select("ts_code", "idx", "label").dropna(), ["ts_code", "idx"])
    return S.rank_ic(out, ["idx"], score="prediction", least=MIN).select("idx", "n", F.round("spearman", 6).alias("spearman"))


@query()
def mod_sparse_selection(spark: SparkSession, d: str) -> DataFrame:
    """Which standardised signals keep a weight in an elastic net whose penalty later sessions choose."""
    xs = ["score", "quiet", "thin"]
    own = scored(spark, d).withColumn("y", F.greatest(F.lit(-0.3), F.least(F.lit(0.3), "label")) + F.when(F.col("label").isNotNull(), 0.0))
    weights, penalty, mix = M.lasso_by_time(own, "idx", xs, "y")
    return spark.createDataFrame([(n, round(w, 8), penalty, mix) for n, w in weights.items()], "signal string, weight double, penalty double, mix double")


@query()
def mod_library_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the factor library with alike subtrees."""
    return near_duplicates(library(spark, {n: x for n, (_, x) in FACTORS.items()}), 0.6)


_PRINTS = ", ".join(f"round(sum((v - 0.5) * case when substr(md5('11|' || ts_code || '|' || trade_date), {i + 1}, 1) < '8' then 1.0 else -1.0 end) / sqrt(count(*)), 6) + 0.0 as f{i}" for i in range(32))


@query(BASE + ", u as (select 'score' as signal, ts_code, trade_date, score as v from scored union all select 'quiet', ts_code, trade_date, quiet from scored), p as (select signal, " + _PRINTS + " from u where v is not null group by 1) select a.signal, " + ", ".join(f"a.f{i}" for i in range(32)) + ", round(list_cosine_similarity([" + ", ".join(f"a.f{i}" for i in range(32)) + "], [" + ", ".join(f"b.f{i}" for i in range(32)) + "]), 5) + 0.0 as with_score from p a, p b where b.signal = 'score'")
def mod_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of two signals, and the cosine of each with the first one's."""
    own, parts = scored(spark, d), None
    for n in ("score", "quiet"):
        f = M.fingerprint(own, "trade_date", n).select(F.lit(n).alias("signal"), F.transform("fingerprint", lambda x: F.round(x, 6) + 0.0).alias("p"), F.lit("score").alias("_k"))
        parts = f if parts is None else parts.unionByName(f)
    base = parts.filter("signal = 'score'").select("_k", F.col("p").alias("q"))
    return parts.join(base, "_k").select("signal", *(F.col("p")[i].alias(f"f{i}") for i in range(32)), (F.round(M.likeness("p", "q"), 5) + 0.0).alias("with_score"))


@query("with v as (select vec_id, embedding::double[] as e from embeddings), q as (select * from v where vec_id % 50 = 0), n as (select q.vec_id as query, v.vec_id as neighbour, list_cosine_similarity(q.e, v.e) as c from q join v on q.vec_id <> v.vec_id), k as (select *, cast(row_number() over (partition by query order by c desc, neighbour) as int) as rank from n) select query, neighbour, rank, round(c, 6) as cosine from k where rank <= 10")
def mod_nearest(spark: SparkSession, d: str) -> DataFrame:
    return M.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 10).select("query", "neighbour", "rank", F.round("cosine", 6).alias("cosine"))


# Regimes, crowding, exposure


@query(_MARKET_SQL + ", x as (select idx, sum(ln(1 + m)) over (order by idx) as w, count(m) over f as n, avg(m) over f as a from market window f as (order by idx rows 59 preceding)) select idx, round(w, 6) + 0.0 as level, case when n = 60 then a > 0 end as bull from x")
def mod_regime_trend(spark: SparkSession, d: str) -> DataFrame:
    f = Window.orderBy("idx").rowsBetween(-59, 0)  # one row a session
    so_far = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    own = _market(spark, d)
    return own.select("idx", (F.round(F.sum(F.log1p("m")).over(so_far), 6) + 0.0).alias("level"), F.when(F.count("m").over(f) == 60, F.avg("m").over(f) > 0).alias("bull"))


@query()
def mod_regime_states(spark: SparkSession, d: str) -> DataFrame:
    """Hidden states of the market's returns (one number a session)."""
    own = _market(spark, d).dropna().orderBy("idx").toPandas()
    if len(own) < 10:
        return spark.createDataFrame([], "idx int, state int")
    states, _ = M.regimes_by_mixture(own["m"].to_numpy())
    return spark.createDataFrame([(int(i), int(s)) for i, s in zip(own["idx"], states)], "idx int, state int")


@query(panel_sql(["amount"]) + ", p as (select ts_code, trade_date, percent_rank() over (partition by trade_date order by amount) as p from panel where amount is not null) select ts_code, min(trade_date) as first, max(trade_date) as last, count(*) as n, round(avg((p < 0.1)::int), 6) as fragile from p group by 1")
def mod_survivorship(spark: SparkSession, d: str) -> DataFrame:
    return M.survivorship(dense_panel(spark, d, ["amount"]), "trade_date", "ts_code", "amount").select("ts_code", "first", "last", "n", F.round("fragile", 6).alias("fragile"))


@query(panel_sql(["amount"]) + ", f as (select *, row_number() over (partition by idx order by amount desc, ts_code) as r, count(*) over (partition by idx) as n from panel where amount is not null), g as (select idx, sum(amount) filter (r <= greatest(ceil(n * 0.05), 1)) / nullif(sum(amount), 0) as s from f group by 1) select idx, round(s, 6) as share, round(case when count(s) over w = 20 then avg(s) over w end, 6) as crowding from g window w as (order by idx rows 19 preceding)")
def mod_market_crowding(spark: SparkSession, d: str) -> DataFrame:
    own = M.market_crowding(dense_panel(spark, d, ["amount"]), "idx", "amount")
    return own.select("idx", F.round("share", 6).alias("share"), F.round("crowding", 6).alias("crowding"))


_R1 = {"ret": fn("clip", r, par=(-0.31, 0.31))}


@query(panel_sql(["close"]) + named("rr", "panel", _R1, ["ts_code", "idx"], digits=8) + ", f as (select *, greatest(ret, 0) as g, row_number() over (partition by idx order by ret desc, ts_code) as k, count(*) over (partition by idx) as n from rr where ret is not null), h as (select idx, stddev_samp(ret) as dispersion, sum(g * g) / pow(nullif(sum(g), 0), 2) as hhi, sum(g) filter (k <= ceil(n * 0.1)) / nullif(sum(g), 0) as head from f group by 1) select idx, round(dispersion, 6) as dispersion, round(hhi, 6) as hhi, round(head, 6) as head, round(case when count(dispersion) over w = 60 and stddev_samp(dispersion) over w > 1e-12 then (dispersion - avg(dispersion) over w) / stddev_samp(dispersion) over w end, 6) + 0.0 as z from h window w as (order by idx rows 59 preceding)")
def mod_doability(spark: SparkSession, d: str) -> DataFrame:
    own = evaluate(dense_panel(spark, d, ["close"]), _R1).select("ts_code", "idx", (F.round("ret", 8) + 0.0).alias("ret"))
    m = M.doability(own, "idx", "ret")
    return m.select("idx", *(F.round(x, 6).alias(x) for x in ("dispersion", "hhi", "head")), (F.round("z", 6) + 0.0).alias("z"))


@query(BASE + ", t as (select *, row_number() over (partition by idx order by score desc, ts_code) as k from scored where score is not null), g as (select idx, industry, sum(0.1) as w from t where k <= 10 group by all) select idx, industry, round(w, 6) as weight, round(w - lag(w) over (partition by industry order by idx), 6) + 0.0 as drift from g".replace("sum(0.1)", "sum(cast(0.1 as double))"))
def mod_exposure(spark: SparkSession, d: str) -> DataFrame:
    own = scored(spark, d).filter("score is not null").withColumn("k", F.row_number().over(Window.partitionBy("idx").orderBy(F.col("score").desc(), "ts_code"))).filter("k <= 10").withColumn("w", F.lit(0.1))
    e = M.exposure(own, "idx", "industry", "w")
    return e.select("idx", "industry", F.round("weight", 6).alias("weight"), (F.round("drift", 6) + 0.0).alias("drift"))


@query(BASE + ic_sql("idx") + ", f as (select idx, avg(spearman) over (order by idx rows 19 preceding) as now, avg(spearman) over p as past, count(spearman) over p as n from ic where spearman is not null window p as (order by idx rows between unbounded preceding and 20 preceding)) select idx, round(now, 6) + 0.0 as now, round(past, 6) + 0.0 as past, now / past < 0.5 as alert from f where n >= 20 and abs(past) > 1e-12")
def mod_decay_alerts(spark: SparkSession, d: str) -> DataFrame:
    a = M.decay_alerts(_ic(spark, d), "idx", "spearman")
    return a.select("idx", (F.round("now", 6) + 0.0).alias("now"), (F.round("past", 6) + 0.0).alias("past"), "alert")


@query(panel_sql(["amount", "turnover"], True) + ", g as (select industry, idx, sum(amount) as a, avg(turnover) as t from panel where industry is not null group by all having avg(turnover) is not null), h as (select *, a - lag(a) over w as flow, percent_rank() over (partition by idx order by t) as pt, a / nullif(sum(a) over (partition by idx), 0) as share from g window w as (partition by industry order by idx)) select industry, idx, round(flow, 3) + 0.0 as flow, round(pt, 6) as turnover_place, round(share, 6) as share, round(share - lag(share) over (partition by industry order by idx), 6) + 0.0 as share_change from h")
def mod_industry_crowding(spark: SparkSession, d: str) -> DataFrame:
    g = dense_panel(spark, d, ["amount", "turnover"], True).filter("industry is not null").groupBy("industry", "idx").agg(F.sum("amount").alias("a"), F.avg("turnover").alias("t")).filter("t is not null")
    w, day = Window.partitionBy("industry").orderBy("idx"), Window.partitionBy("idx")
    total = F.sum("a").over(day)
    h = g.withColumns({"flow": F.col("a") - F.lag("a").over(w), "pt": F.percent_rank().over(day.orderBy("t")), "share": F.col("a") / F.when(total != 0, total)})
    return h.select("industry", "idx", (F.round("flow", 3) + 0.0).alias("flow"), F.round("pt", 6).alias("turnover_place"), F.round("share", 6).alias("share"), (F.round(F.col("share") - F.lag("share").over(w), 6) + 0.0).alias("share_change"))


# Portfolios over time


@query(BASE + ", f as (select *, rank() over (partition by trade_date order by score desc) as r, count(*) over (partition by trade_date, score) as m, least(count(*) over (partition by trade_date), 10) as n from scored where score is not null), g as (select trade_date, ts_code, industry, least(case when n - r + 1 >= m then 1.0 / n when n - r + 1 > 0 then 1.0 * (n - r + 1) / n / m end, 0.2) as w from f where n - r + 1 > 0), h as (select *, sum(w) over (partition by trade_date, industry) as t from g) select trade_date, ts_code, round(case when t > 0.4 then w * 0.4 / t else w end, 6) as weight from h")
def sim_target_weights(spark: SparkSession, d: str) -> DataFrame:
    w = X.target_weights(scored(spark, d), "trade_date", "ts_code", "score", 10, 1.0, 0.2, "industry", 0.4)
    return w.select("trade_date", "ts_code", F.round("weight", 6).alias("weight"))


@query(BASE + ", p as (select idx // 5 as b, ts_code from scored where idx % 5 = 0 and score is not null qualify row_number() over (partition by idx order by score desc, ts_code) <= 10), c as (select p.b, 1 - count(q.ts_code) / count(*) as t from p left join p q on q.b = p.b - 1 and q.ts_code = p.ts_code group by 1), g as (select s.idx, s.idx // 5 as b, avg(s.label) as gross from scored s join p on p.b = s.idx // 5 and p.ts_code = s.ts_code group by all) select g.idx, round(gross, 6) + 0.0 as gross, round(case when g.idx % 5 = 0 then c.t else 0 end, 6) as turnover, round(gross - case when g.idx % 5 = 0 then c.t else 0 end * 0.001, 6) + 0.0 as net from g join c using (b)")
def sim_held_top_n(spark: SparkSession, d: str) -> DataFrame:
    own = X.held_returns(scored(spark, d), "idx", "ts_code", "score", "label", 10, 5, 0.001)
    return own.select("idx", (F.round("gross", 6) + 0.0).alias("gross"), F.round("turnover", 6).alias("turnover"), (F.round("net", 6) + 0.0).alias("net"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    w = X.target_weights(scored(spark, d), "idx", "ts_code", "score", 10)
    return w.filter(F.col("idx") % 5 == 0).withColumn("account", F.lit("base"))


@query()
def sim_turnover_limited(spark: SparkSession, d: str) -> DataFrame:
    return X.turnover_limited(_targets(spark, d), "account", "idx", "ts_code", "weight", 0.5).select("account", "idx", "ts_code", F.round("weight", 8).alias("weight"))


@query()
def sim_account(spark: SparkSession, d: str) -> DataFrame:
    """Two accounts that rebalance every five sessions at the next open, by each of two signals."""
    own = scored(spark, d)
    plans = None
    for name in ("score", "quiet"):
        w = X.target_weights(own, "idx", "ts_code", name, 10).filter(F.col("idx") % 5 == 0)
        part = w.select(F.lit(name).alias("account"), (F.col("idx") + 1).alias("idx"), "ts_code", "weight")
        plans = part if plans is None else plans.unionByName(part)
    plans = written(plans)
    panel = dense_panel(spark, d, ["open", "close", "volume", "up_limit", "down_limit"])
    before = F.lag("volume").over(Window.partitionBy("ts_code").orderBy("idx")) * 100
    names = plans.select("account", "ts_code").distinct()
    days = plans.select("account", "idx").distinct().withColumn("_d", F.lit(0.0))
    rows = panel.withColumn("before", before).join(names, "ts_code").join(plans, ["account", "idx", "ts_code"], "left").join(days, ["account", "idx"], "left")
    rows = rows.withColumn("weight", F.coalesce("weight", "_d"))  # on a decision day what isn't chosen is sold
    halved = days_at(spark, d, "20230828")  # the tax on sales
    return X.simulate_accounts(rows, "account", "idx", "ts_code", tax=[(0, "0.001"), (halved, "0.0005")], entitlements=_entitlements(spark, d))


def days_at(spark: SparkSession, d: str, day: str) -> int:
    """Number of the first session from a day on."""
    return sessions(spark, d).filter(F.col("trade_date") >= day).agg(F.coalesce(F.min("idx"), F.lit(1 << 30))).first()[0]


def _entitlements(spark: SparkSession, d: str) -> DataFrame:
    """Cash and shares for each share by instrument and record session, from distinct announcements; days become the sessions from
    them on. Rows of one record session add up, at their last ex, payment and listing sessions."""
    v = table(spark, d, "dividend").select(instrument_code("ts_code").alias("ts_code"), *(compact_date(c).alias(c) for c in ("record_date", "ex_date", "pay_date", "div_listdate")), "cash_div", "stk_div").distinct()
    v = v.filter("record_date is not null and ex_date is not null and ex_date > record_date")
    open_days = table(spark, d, "trade_cal").select("cal_date", "is_open")
    number = sessions(spark, d).select(F.col("trade_date").alias("cal_date"), "idx")
    w = Window.orderBy("cal_date").rowsBetween(0, Window.unboundedFollowing)  # one row a calendar day
    next_session = open_days.join(number, "cal_date", "left").select("cal_date", F.min("idx").over(w).alias("_i"))
    for c, name in (("record_date", "idx"), ("ex_date", "ex"), ("pay_date", "paid"), ("div_listdate", "listed")):
        v = v.join(next_session.select(F.col("cal_date").alias(c), F.col("_i").alias(name)), c, "left")
    own = v.filter("idx is not null and ex is not null").groupBy("ts_code", "idx")
    return own.agg(F.sum("cash_div").alias("cash"), F.sum("stk_div").alias("stock"), F.max("ex").alias("ex"), F.max("paid").alias("paid"), F.max("listed").alias("listed"))


@query("select o_custkey, o_orderkey, cast(sum(cast(o_totalprice as decimal(18, 4))) over (partition by o_custkey order by o_orderdate, o_orderkey) as double) as balance, false as conflict from orders")
def sim_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events of customers' accounts, delivered twice."""
    e = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    own = X.ledger_balances(e.unionByName(e), "o_custkey", F.col("o_orderdate"), "o_orderkey", "o_totalprice", ["o_totalprice", "o_orderstatus"])
    return own.withColumn("balance", F.col("balance").cast("double"))


def _run(n: int) -> Node:
    """Sessions in a row with returns of the last one's sign, with that sign, within the last ``n``."""
    s = fn("sign", r)
    length = smaller(fn("last_true", fn("ne", s, fill(lag(s), 9))) + 1, n)
    return where(mean(absolute(r), n) >= 0, s * length)


_XGB = {f"r{k}": pct(c, k) for k in (1, 2, 3, 5, 10, 20, 40, 60)} | {f"sd{k}": std(r, k, ddof=0) for k in (5, 10, 20)} | {
    "drawdown": parse("close / ts_max(close, 20) - 1"), "volume_ratio": parse("volume / ma(volume, 20)"), "amplitude": parse("(high - low) / close.shift(1)"), "up_ratio": mean(r > 0, 10), "gap": o / lag(c) - 1,
    "drawdown_5": parse("close / ts_max(close, 5) - 1"), "drawdown_10": parse("close / ts_max(close, 10) - 1"), "volume_ratio_5": parse("volume / ma(volume, 5)"),
    "amplitude_5": mean((h - l) / c, 5), "amplitude_20": mean((h - l) / c, 20), "up_ratio_20": mean(r > 0, 20), "streak": _run(10), "gap_5": mean(o / lag(c) - 1, 5),
}
QUERIES["fac_price_volume_features"], SQL["fac_price_volume_features"] = panel_query(_XGB)

