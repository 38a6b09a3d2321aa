"""Inference on series: block bootstrap, multiple testing, performance, folds, dominance."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import below


def block_bootstrap(series: DataFrame, order: str, value: str, block: int, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """Means and deviations of circular moving-block replicates: (``replicate``, ``mean``, ``sd``). Missing values keep their place and a
    replicate's mean is a ratio of sums. A block's start is a hash of seed, replicate and block, so that draws depend on
    nothing else; its sums are differences of the series' running sums, met by equi-joins on the place in the series."""
    spark = series.sparkSession
    w = Window.orderBy(order)  # one row a session
    rows = series.select(F.col(value).cast("double").alias("_v"), F.row_number().over(w).alias("_p"), F.row_number().over(w).alias("_o"))
    so_far = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"_s": F.sum(F.coalesce("_v", F.lit(0.0))), "_q": F.sum(F.coalesce(F.col("_v") * F.col("_v"), F.lit(0.0))), "_k": F.count("_v")}
    past = rows.select("_p", *(s.over(so_far).cast("double").alias(c) for c, s in sums.items()))
    n, *whole = past.agg(F.coalesce(F.max("_p"), F.lit(0)), *(F.coalesce(F.max_by(c, "_p"), F.lit(0.0)) for c in sums)).first()
    if not n:
        return spark.range(replicates).select(F.col("id").alias("replicate"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("sd"))
    size = min(block, n)
    blocks = -(-n // size)
    past = past.unionByName(spark.range(1).select(F.lit(0).alias("_p"), *(F.lit(0.0).alias(c) for c in sums)))
    drawn = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_j"))
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("_j").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % n
    drawn = drawn.withColumn("_a", start.cast("int"))
    drawn = drawn.withColumn("_b", F.col("_a") + F.when(F.col("_j") < blocks - 1, F.lit(size)).otherwise(F.lit(n - size * (blocks - 1))))
    ends = drawn.select("replicate", F.explode(F.array(F.struct(F.col("_a").alias("_p"), F.lit(-1.0).alias("_w"), F.lit(0.0).alias("_t")), F.struct(F.when(F.col("_b") > n, F.col("_b") - n).otherwise(F.col("_b")).alias("_p"), F.lit(1.0).alias("_w"), (F.col("_b") > n).cast("double").alias("_t")))).alias("e")).select("replicate", "e.*")
    met = ends.join(past, "_p").groupBy("replicate").agg(*(F.sum(F.col("_w") * F.col(c) + F.col("_t") * x).alias(c) for c, x in zip(sums, whole)))
    mean = F.col("_s") / F.when(F.col("_k") > 0, F.col("_k"))
    var = (F.col("_q") - F.col("_k") * mean * mean) / F.when(F.col("_k") > 1, F.col("_k") - 1)
    return met.select("replicate", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))


def bootstrap_interval(means: DataFrame, level: float = 0.95) -> DataFrame:
    """One row: both ends of the interval and the share of replicates at or below 0 (one-sided p, never 0)."""
    a = (1 - level) / 2
    return means.agg(F.percentile("mean", F.lit(a)).alias("low"), F.percentile("mean", F.lit(1 - a)).alias("high"), ((F.sum((F.col("mean") <= 0).cast("int")) + 1) / (F.count("mean") + 1)).alias("p"))


def lower_icir_bound(series: DataFrame, order: str, value: str, block: int, shrink: float = 0.047, level: float = 0.05, replicates: int = 500) -> DataFrame:
    """One row ``bound``: the lower quantile over circular-block replicates of mean / (sd + shrink)."""
    return block_bootstrap(series, order, value, block, replicates).agg(F.percentile(F.col("mean") / (F.col("sd") + shrink), F.lit(level)).alias("bound"))


def hac_variance(series: DataFrame, order: str, value: str, lags: int) -> DataFrame:
    """Bartlett-weighted long-run variance of the mean: one row (``n``, ``mean``, ``variance``)."""
    w = Window.orderBy(order)  # one row a session
    own = series.filter(F.col(value).isNotNull()).withColumn("_m", F.avg(value).over(Window.partitionBy()))
    own = own.withColumn("_e", F.col(value) - F.col("_m"))
    own = own.withColumns({f"_l{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    n = F.count(F.lit(1))
    total = F.sum(F.col("_e") * F.col("_e")) / n
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("_e") * F.col(f"_l{k}")), F.lit(0.0)) / n
    return own.agg(n.alias("n"), F.avg(value).alias("mean"), (total / n).alias("variance"))


def holm(tests: DataFrame, name: str, p: str) -> DataFrame:
    """Step-down adjusted p-values; ties by name; null p-values are no tests."""
    own = tests.filter(F.col(p).isNotNull())
    w = Window.orderBy(p, name)  # one row a test
    n = F.count(F.lit(1)).over(Window.partitionBy())
    scaled = F.least(F.lit(1.0), (n - F.row_number().over(w) + 1) * F.col(p))
    return own.withColumn("_s", scaled).withColumn("holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def benjamini_hochberg(tests: DataFrame, name: str, p: str) -> DataFrame:
    """Step-up adjusted p-values."""
    own = tests.filter(F.col(p).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy())
    scaled = F.least(F.lit(1.0), n / F.row_number().over(Window.orderBy(p, name)) * F.col(p))
    back = Window.orderBy(F.col(p).desc(), F.col(name).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("_s", scaled).withColumn("bh", F.min("_s").over(back)).drop("_s")


def required_sections(mean: float, sd: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Sections that a mean of this size needs to be told from 0."""
    q = NormalDist().inv_cdf
    return math.ceil(((q(1 - alpha / 2) + q(power)) * sd / mean) ** 2) if mean else 0


def best_by_chance(trials: int, spread: float) -> float:
    """Sharpe ratio that the best of so many trials without skill would show."""
    norm, gamma = NormalDist(), 0.5772156649015329
    return spread * ((1 - gamma) * norm.inv_cdf(1 - 1 / trials) + gamma * norm.inv_cdf(1 - 1 / (trials * math.e))) if trials > 1 else 0.0


def deflated_sharpe(returns: DataFrame, value: str, trials: int, spread: float) -> DataFrame:
    """One row (``n``, ``probability``): that a Sharpe ratio (per period) exceeds what the best of ``trials`` without skill would show;
    null for fewer than three periods or no variance."""
    s = returns.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))
    ratio = F.col("m") / F.when(F.col("sd") > 0, F.col("sd"))
    z = (ratio - best_by_chance(trials, spread)) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * ratio + (F.col("kurt") - 1) / 4 * ratio * ratio)
    return s.select("n", F.when(F.col("n") > 2, below(z)).alias("probability"))


def overfitting_probability(table: np.ndarray, parts: int = 8) -> float:
    """Share of balanced splits of the periods (rows) in which the best strategy (column) inside is below the median outside."""
    from itertools import combinations

    blocks, worse, n = np.array_split(np.arange(len(table)), parts), 0, 0
    for inside in combinations(range(parts), parts // 2):
        a = np.concatenate([blocks[i] for i in inside])
        b = np.setdiff1d(np.arange(len(table)), a)
        ratio = lambda x: x.mean(0) / (x.std(0, ddof=1) + 1e-12)
        best, out = ratio(table[a]).argmax(), ratio(table[b])
        worse += (out < out[best]).mean() + (out == out[best]).mean() / 2 <= 0.5
        n += 1
    return worse / n


def performance(returns: DataFrame, order: str, value: str, by: list[str] = (), year: int = 252) -> DataFrame:
    """Total return, greatest fall from a peak, mean, deviation, Sharpe and Calmar ratios of period returns; null returns are
    no periods. Paths run over one row a period."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = returns.filter(F.col(value).isNotNull() & (F.col(value) > -1)).withColumn("_w", F.sum(F.log1p(value)).over(w))
    own = own.withColumn("_p", F.greatest(F.max("_w").over(w), F.lit(0.0)))
    out = own.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.exp(F.sum(F.log1p(value))) - 1).alias("total"), F.max(1 - F.exp(F.col("_w") - F.col("_p"))).alias("drawdown"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    yearly = F.pow(1 + F.col("total"), year / F.col("n")) - 1
    return out.withColumns({"sharpe": F.when(F.col("sd") > 0, F.col("mean") / F.when(F.col("sd") > 0, F.col("sd")) * math.sqrt(year)), "calmar": F.when(F.col("drawdown") > 0, yearly / F.when(F.col("drawdown") > 0, F.col("drawdown")))})


def folds(sessions: DataFrame, order: str, train: int, test: int, step: int, embargo: int = 0, anchored: bool = False) -> DataFrame:
    """(``fold``, train from/to, test from/to) of a walk forward over session numbers; an embargo lies between the two."""
    ends = sessions.agg(F.min(order).alias("a"), F.max(order).alias("b"))
    start = F.explode(F.sequence("a", F.greatest("a", F.col("b") - train - embargo - test + 1), F.lit(step)))
    each = ends.select("a", "b", start.alias("s")).filter(F.col("s") + train + embargo + test - 1 <= F.col("b"))
    first = F.col("a") if anchored else F.col("s")
    return each.select(((F.col("s") - F.col("a")) / step).cast("int").alias("fold"), first.alias("train_from"), (F.col("s") + train - 1).alias("train_to"), (F.col("s") + train + embargo).alias("test_from"), (F.col("s") + train + embargo + test - 1).alias("test_to"))


def k_fold(order: Column, k: int, block: int) -> Column:
    """Fold of a session: blocks of sessions dealt out in turn."""
    return F.pmod(F.floor(order / block), F.lit(k)).cast("int")


def fronts(points: np.ndarray) -> np.ndarray:
    """Non-dominated sorting, greater is better: 0 for points that none dominates, and so on. For candidates of one round."""
    n = len(points)
    ge = (points[:, None, :] >= points[None, :, :]).all(2)
    beats = ge & ~ge.T
    left, out, level = np.ones(n, bool), np.zeros(n, int), 0
    while left.any():
        now = left & ~(beats & left[:, None]).any(0)
        out[now] = level
        left &= ~now
        level += 1
    return out


def crowding(points: np.ndarray) -> np.ndarray:
    """Distance of each point of a front to its neighbours; the ends are infinitely far."""
    out = np.zeros(len(points))
    for j in range(points.shape[1]):
        order = np.argsort(points[:, j], kind="stable")
        span = points[order[-1], j] - points[order[0], j]
        out[order[[0, -1]]] = np.inf
        if span > 0 and len(order) > 2:
            out[order[1:-1]] += (points[order[2:], j] - points[order[:-2], j]) / span
    return out


def pareto(candidates: DataFrame, name: str, goals: list[str]) -> DataFrame:
    """Candidates that no other one dominates, all goals greater is better. Candidates sorted by their first goal need only be
    held against the best of the second so far, so two goals take one window; more are compared on the driver's side."""
    if len(goals) != 2:
        raise ValueError("two goals; use fronts() for more")
    a, b = goals
    own = candidates.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    tops = own.groupBy(a).agg(F.max(b).alias("_top"))
    tops = tops.withColumn("_above", F.max("_top").over(Window.orderBy(F.col(a).desc()).rowsBetween(Window.unboundedPreceding, -1)))
    return own.join(tops, a).filter((F.col(b) == F.col("_top")) & (F.col("_above").isNull() | (F.col(b) > F.col("_above")))).select(*candidates.columns)


def upper_confidence(pulls: dict[str, tuple[int, float]], heat: float = 1.4) -> str:
    """Arm (name -> pulls, mean) with the greatest upper bound; arms never pulled come first, by name."""
    total = sum(n for n, _ in pulls.values())
    return min(pulls, key=lambda a: (pulls[a][0] > 0, -(pulls[a][1] + heat * math.sqrt(math.log(max(total, 1)) / pulls[a][0])) if pulls[a][0] else 0.0, a))


def concentration(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Herfindahl index of ``value`` over ``key``."""
    own = rows.groupBy(*by, key).agg(F.sum(value).alias("_v"))
    return own.groupBy(*by).agg((F.sum(F.col("_v") * F.col("_v")) / F.when(F.sum("_v") != 0, F.sum("_v") * F.sum("_v"))).alias("hhi"))


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    p = hits / F.when(n > 0, n)
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
