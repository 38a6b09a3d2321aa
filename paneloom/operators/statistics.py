"""Cross-sectional statistics: rank correlations by session, their decay and stability, quantile portfolios.

Everything is windows over a session and aggregates by session; a session's group is bounded by the number of instruments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import quantile

TINY = 1e-12


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson correlation, null where a side is constant, held within -1..1."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    flat = (sx <= F.abs(F.avg(x)) * TINY) | (sy <= F.abs(F.avg(y)) * TINY) | (sx <= TINY) | (sy <= TINY)
    return F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(x, y) / F.when(sx * sy > 0, sx * sy))))


def average_rank(x: str, by: list[str]) -> Column:
    """Average rank of a column without nulls over the groups ``by``."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


def pairs(scored: DataFrame, score: str, label: str) -> DataFrame:
    return scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())


def rank_ic(scored: DataFrame, by: list[str], score: str = "score", label: str = "label", least: int = 3) -> DataFrame:
    """(by, ``n``, ``pearson``, ``spearman``) of pairs without nulls; groups with fewer than ``least`` pairs or a constant side have
    null correlations: both are given or none."""
    own = pairs(scored, score, label).withColumns({"_rs": average_rank(score, by), "_rl": average_rank(label, by)})
    out = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(score, label).alias("_p"), correlation("_rs", "_rl").alias("_s"))
    fine = (F.col("n") >= least) & F.col("_p").isNotNull() & F.col("_s").isNotNull()
    return out.select(*by, "n", F.when(fine, F.col("_p")).alias("pearson"), F.when(fine, F.col("_s")).alias("spearman"))


def closed_form_ic(scored: DataFrame, by: list[str], score: str = "score", label: str = "label", least: int = 3) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)): differs from the correlation of ranks where there are ties."""
    own = pairs(scored, score, label).withColumn("_d", average_rank(score, by) - average_rank(label, by))
    n = F.count(F.lit(1)).cast("double")
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(n >= least, 1 - 6 * F.sum(F.col("_d") * F.col("_d")) / F.when(n > 1, n * (n * n - 1))).alias("ic"))


def describe(series: DataFrame, value: str, by: list[str] = (), ddof: int = 1) -> DataFrame:
    """Mean, deviation, ratio of both (not annualised), share above 0 (rounding noise is 0), t statistic and count."""
    sd = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    own = series.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), F.avg((F.col(value) > 1e-9).cast("double")).alias("positive"))
    ratio = F.when(F.col("sd") > TINY, F.col("mean") / F.col("sd"))
    return own.withColumns({"icir": ratio, "t": ratio * F.sqrt("n")})


def coverage(panel: DataFrame, session: str, score: str, label: str) -> DataFrame:
    have = lambda c: F.count(c)
    return panel.groupBy(session).agg(F.count(F.lit(1)).alias("universe"), have(score).alias("signals"), have(label).alias("labels"), F.count(F.when(F.col(score).isNotNull() & F.col(label).isNotNull(), 1)).alias("pairs"))


def half_life(decay: DataFrame, lag: str = "lag", ic: str = "ic") -> DataFrame:
    """Half-life of |ic| over lags, from a line through the first lag's point: ln|ic_k / ic_1| = -rate (k - 1). One row.
    A value that is rounding noise beside 1 is zero and has no logarithm."""
    first = F.max_by(F.abs(ic), -F.col(lag))
    own = decay.agg(first.alias("_f"), F.collect_list(F.struct(lag, ic)).alias("_all")).select("_f", F.explode("_all").alias("e")).select("_f", F.col(f"e.{lag}").alias("k"), F.col(f"e.{ic}").alias("v"))
    x, y = F.col("k") - 1, F.ln(F.when(F.abs("v") > TINY, F.abs("v")) / F.when(F.col("_f") > TINY, F.col("_f")))
    fit = own.filter(y.isNotNull() & (x > 0)).agg((-F.sum(x * y) / F.sum(x * x)).alias("rate"))
    return fit.withColumn("half_life", F.when(F.col("rate") > 0, F.ln(F.lit(2.0)) / F.col("rate")))


def histogram_persistence(scored: DataFrame, session_no: str, score: str, bins: int = 10, edge: float = 3.5) -> DataFrame:
    """Kullback-Leibler distance of each session's histogram from that of the session before, add-one smoothed. One row:
    its mean and 1 / (1 + mean)."""
    slot = F.least(F.greatest(F.floor((F.col(score) + edge) / (2 * edge) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    own = scored.filter(F.col(score).isNotNull()).groupBy(session_no).agg(F.count(F.lit(1)).alias("_n"), *(F.count(F.when(slot == i, 1)).alias(f"_h{i}") for i in range(bins)))
    w = Window.orderBy(session_no)  # one row a session
    p = [(F.col(f"_h{i}") + 1) / (F.col("_n") + bins) for i in range(bins)]
    own = own.withColumns({f"_p{i}": c for i, c in enumerate(p)})
    own = own.withColumns({f"_q{i}": F.lag(f"_p{i}").over(w) for i in range(bins)})
    kl = sum((F.col(f"_p{i}") * F.ln(F.col(f"_p{i}") / F.col(f"_q{i}")) for i in range(1, bins)), F.col("_p0") * F.ln(F.col("_p0") / F.col("_q0")))
    return own.select(kl.alias("_kl")).agg(F.avg("_kl").alias("distance")).withColumn("persistence", 1 / (1 + F.col("distance")))


# Portfolios


def quantiles(scored: DataFrame, session: str, score: str, n: int, tie: str = "ts_code", within: list[str] = ()) -> DataFrame:
    """``quantile`` 1..n by score; sizes differ by at most one, the first groups are larger; rows without a score are left out."""
    return scored.filter(F.col(score).isNotNull()).withColumn("quantile", F.ntile(n).over(Window.partitionBy(session, *within).orderBy(score, tie)))


def quantile_returns(scored: DataFrame, session: str, score: str, label: str, n: int, least: int) -> DataFrame:
    """Mean label of each quantile of the sessions that have ``least`` pairs."""
    own = pairs(scored, score, label).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(session))).filter(F.col("_n") >= least)
    return quantiles(own, session, score, n).groupBy(session, "quantile").agg(F.avg(label).alias("label"), F.count(F.lit(1)).alias("n"))


def monotonicity(returns: DataFrame) -> DataFrame:
    """One row: spread of the last over the first quantile, rank correlation of the quantiles' order, share of neighbours that rise."""
    means = returns.groupBy("quantile").agg(F.avg("label").alias("m"))
    w = Window.orderBy("quantile")  # one row a quantile
    own = means.withColumns({"_up": F.when(F.lag("m").over(w).isNotNull(), (F.col("m") > F.lag("m").over(w)).cast("double")), "_r": F.rank().over(Window.orderBy("m")).cast("double"), "_q": F.col("quantile").cast("double")})
    return own.agg((F.max_by("m", "quantile") - F.min_by("m", "quantile")).alias("spread"), correlation("_r", "_q").alias("order"), F.avg("_up").alias("rising"))


def decile_curve(scored: DataFrame, session: str, score: str, label: str, tie: str = "ts_code") -> DataFrame:
    own = pairs(scored, score, label)
    w = Window.partitionBy(session)
    pct = F.row_number().over(w.orderBy(score, tie)) / F.count(F.lit(1)).over(w)
    return own.withColumn("decile", F.least(F.floor(pct * 10), F.lit(9)).cast("int")).groupBy("decile").agg(F.avg(label).alias("label"), F.count(F.lit(1)).alias("n"))


def double_sort(scored: DataFrame, session: str, size: str, score: str, label: str, sizes: int = 3, groups: int = 5) -> DataFrame:
    """Size groups first, then score groups within them: mean label of each cell over all sessions."""
    own = pairs(scored, score, label).filter(F.col(size).isNotNull())
    own = own.withColumn("size_group", F.ntile(sizes).over(Window.partitionBy(session).orderBy(size, "ts_code")))
    own = own.withColumn("score_group", F.ntile(groups).over(Window.partitionBy(session, "size_group").orderBy(score, "ts_code")))
    return own.groupBy("size_group", "score_group").agg(F.avg(label).alias("label"), F.count(F.lit(1)).alias("n"))


def rank_autocorrelation(scored: DataFrame, key: str, order: str, score: str, lags: list[int], least: int = 3) -> DataFrame:
    """(``lag``, mean over sessions of the correlation of ranks with those ``lag`` sessions before)."""
    ranked = scored.filter(F.col(score).isNotNull()).withColumn("_r", average_rank(score, [order])).select(key, order, "_r")
    out = None
    for k in lags:
        old = ranked.select(key, (F.col(order) + k).alias(order), F.col("_r").alias("_o"))
        per = ranked.join(old, [key, order]).groupBy(order).agg(F.when(F.count(F.lit(1)) >= least, correlation("_r", "_o")).alias("_c"))
        part = per.agg(F.lit(k).alias("lag"), F.avg("_c").alias("autocorrelation"))
        out = part if out is None else out.unionByName(part)
    return out


def top_turnover(scored: DataFrame, key: str, order: str, score: str, n: int) -> DataFrame:
    """(session, ``held``, ``kept``, ``turnover``): share of the best ``n`` names that were not among them the session before."""
    top = scored.filter(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(order).orderBy(F.col(score).desc(), key))).filter(F.col("_r") <= n).select(key, order)
    old = top.select(key, (F.col(order) + 1).alias(order), F.lit(1).alias("_was"))
    per = top.join(old, [key, order], "left").groupBy(order).agg(F.count(F.lit(1)).alias("held"), F.count("_was").alias("kept"))
    return per.withColumn("turnover", 1 - F.col("kept") / F.col("held"))


def correlation_matrix(scored: DataFrame, session: str, signals: list[str], least: int = 3) -> DataFrame:
    """(``one``, ``other``, mean over sessions of the rank correlation): k(k-1)/2 pair aggregates over one pass, no self-join."""
    own = scored
    for s in signals:
        held = Window.partitionBy(session, F.col(s).isNull())
        r = F.rank().over(held.orderBy(s)) + (F.count(F.lit(1)).over(Window.partitionBy(session, s)) - 1) / 2
        own = own.withColumn(f"_r_{s}", F.when(F.col(s).isNotNull(), r))
    both = [(a, b) for i, a in enumerate(signals) for b in signals[i + 1 :]]
    for a, b in both:
        fine = F.col(f"_r_{a}").isNotNull() & F.col(f"_r_{b}").isNotNull()
        own = own.withColumns({f"_x_{a}_{b}": F.when(fine, F.col(f"_r_{a}")), f"_y_{a}_{b}": F.when(fine, F.col(f"_r_{b}"))})
    per = own.groupBy(session).agg(*(F.when(F.count(f"_x_{a}_{b}") >= least, correlation(f"_x_{a}_{b}", f"_y_{a}_{b}")).alias(f"{a}|{b}") for a, b in both))
    means = per.agg(*(F.avg(f"`{a}|{b}`").alias(f"{a}|{b}") for a, b in both))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("one"), F.lit(b).alias("other"), F.col(f"`{a}|{b}`").alias("correlation")) for a, b in both)))
    return means.select(rows.alias("_e")).select("_e.*")


def variance_inflation(matrix: pd.DataFrame) -> dict[str, float]:
    """Diagonal of the inverse of a small correlation matrix, given as its upper triangle (one, other, correlation)."""
    names = sorted({*matrix["one"], *matrix["other"]})
    m = np.eye(len(names))
    for a, b, c in matrix[["one", "other", "correlation"]].itertuples(index=False):
        i, j = names.index(a), names.index(b)
        m[i, j] = m[j, i] = c
    return dict(zip(names, np.diag(np.linalg.pinv(m)).round(6).tolist()))


def combined(scored: DataFrame, weights: dict[str, float], name: str = "combined") -> Column:
    """Weighted mean of standardised signals over those that are there."""
    held = [(F.col(s), w) for s, w in weights.items()]
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in held[1:]), F.coalesce(held[0][0] * held[0][1], F.lit(0.0)))
    low = sum((F.when(c.isNotNull(), abs(w)).otherwise(0.0) for c, w in held[1:]), F.when(held[0][0].isNotNull(), abs(held[0][1])).otherwise(0.0))
    return F.when(low > 0, top / low).alias(name)


def rank_product(weights: dict[str, float], name: str = "product") -> Column:
    """Product of ranks in (0, 1] to the power of their weights; a negative weight inverts its rank; null if one is missing."""
    parts = [F.ln(F.when(F.col(s) > 0, F.col(s)) if w >= 0 else 1.000001 - F.col(s)) * abs(w) for s, w in weights.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.exp(total).alias(name)


def mixed_ranks(a: str, b: str) -> Column:
    """Half of each rank; null if either is missing."""
    return (F.col(a) * 0.5 + F.col(b) * 0.5).alias("mixed")


def normal_scores(place: Column) -> Column:
    """Standard normal quantiles of ranks in (0, 1), ranks held within 1e-4 of the ends and scores within -4..4."""
    return F.greatest(F.lit(-4.0), F.least(F.lit(4.0), quantile(F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), place))))) + F.when(place.isNotNull(), 0.0)


# Small k by k problems on the driver


def softmax_top(scores: dict[str, float], k: int, heat: float = 1.0) -> dict[str, float]:
    best = sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:k]
    if not best:
        return {}
    e = np.exp((np.array([v for _, v in best]) - best[0][1]) / heat)
    return dict(zip([n for n, _ in best], (e / e.sum()).tolist()))


def inverse_variance(cov: np.ndarray) -> np.ndarray:
    w = 1 / np.diag(cov)
    return w / w.sum()


def equal_risk(cov: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights whose contributions to the variance are equal, by cyclic coordinate descent."""
    w = 1 / np.sqrt(np.diag(cov))
    for _ in range(rounds):
        old = w.copy()
        for i in range(len(w)):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + np.sqrt(rest * rest + 4 * cov[i, i] / len(w))) / (2 * cov[i, i])
        if np.abs(w - old).max() < 1e-12:
            break
    return w / w.sum()


def hierarchical_risk(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single linkage on sqrt((1 - rho) / 2), then inverse-variance bisection down the tree's order."""
    sd = np.sqrt(np.diag(cov))
    gap = np.sqrt(np.clip((1 - cov / np.outer(sd, sd)) / 2, 0, 1))
    clusters = [[i] for i in range(len(sd))]
    while len(clusters) > 1:
        _, i, j = min((min(gap[a, b] for a in x for b in y), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
        clusters[i] = clusters[i] + clusters.pop(j)
    w, todo = np.ones(len(sd)), [clusters[0]]
    risk = lambda own: (lambda p: p @ cov[np.ix_(own, own)] @ p)(inverse_variance(cov[np.ix_(own, own)]))
    while todo:
        own = todo.pop()
        if len(own) < 2:
            continue
        a, b = own[: len(own) // 2], own[len(own) // 2 :]
        share = 1 - risk(a) / (risk(a) + risk(b))
        w[a] *= share
        w[b] *= 1 - share
        todo += [a, b]
    return w / w.sum()
