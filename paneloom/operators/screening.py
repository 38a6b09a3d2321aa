"""Screens, scores and attributions that combine the other operators."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inference import block_bootstrap, bootstrap_interval


def evidence_screen(ic: DataFrame, order: str, value: str, year: str, trials: int = 20, blocks: tuple[int, ...] = (10, 20, 40), replicates: int = 200, alpha: float = 0.05, years: float = 0.6) -> DataFrame:
    """One row: the sign of the mean, the least lower bound over a grid of block lengths at a level divided by the number of trials
    (both in the direction of the mean), the share of years that agree in sign, and whether all hold."""
    own = ic.filter(F.col(value).isNotNull())
    mean = own.agg(F.avg(value)).first()[0] or 0.0
    sign = 1.0 if mean >= 0 else -1.0
    turned = own.select(order, year, (F.col(value) * sign).alias("_v"))
    lows = [bootstrap_interval(block_bootstrap(turned, order, "_v", b, replicates), 1 - 2 * alpha / trials) for b in blocks]
    low = lows[0]
    for x in lows[1:]:
        low = low.unionByName(x)
    agree = turned.groupBy(year).agg(F.avg("_v").alias("_m")).agg(F.avg((F.col("_m") > 0).cast("double"))).first()[0]  # one row
    met = low.agg(F.min("low").alias("low")).withColumn("years", F.lit(agree).cast("double"))
    return met.select(F.lit(sign).alias("direction"), "low", "years", ((F.col("low") > 0) & (F.col("years") >= years)).alias("passed"))


def shrunk_ratio(mean: Column, sd: Column, shrink: float = 0.047) -> Column:
    return mean / (sd + shrink)


def soft_gate(x: Column, sharp: float = 10.0) -> Column:
    """Smooth positive part."""
    return F.log1p(F.exp(F.least(x * sharp, F.lit(700.0)))) / sharp


def composite_return(total: Column, calmar: Column) -> Column:
    """Clipped return and Calmar ratio, weighted 0.7 and 0.3."""
    hold = lambda c, a, b: F.greatest(F.lit(a), F.least(F.lit(b), c))
    return 0.7 * hold(total, -1.0, 2.0) + 0.3 * hold(calmar, -3.0, 5.0) / 5


GRADES = ((0.60, "A"), (0.40, "B"), (0.25, "C"))


def grade(index: Column) -> Column:
    out = F.lit("D")
    for bound, name in reversed(GRADES):
        out = F.when(index >= bound, name).otherwise(out)
    return out


def seats(n: int) -> int:
    """Seats of a round of n candidates: a fifth, at most eight."""
    return min(8, math.ceil(0.2 * n))


def shapley(value, players: list[str], limit: int = 5) -> dict[str, float]:
    """Exact Shapley values of a set function over a few players, each set valued once."""
    if len(players) > limit:
        raise ValueError(f"exact values for up to {limit} players")
    known: dict[frozenset, float] = {}
    of = lambda s: known[s] if s in known else known.setdefault(s, value(sorted(s)))
    out = dict.fromkeys(players, 0.0)
    orders = list(permutations(players))
    for order in orders:
        have: frozenset = frozenset()
        for p in order:
            out[p] += (of(have | {p}) - of(have)) / len(orders)
            have = have | {p}
    return out


def sortino(returns: np.ndarray) -> float:
    down = np.sqrt(np.mean(np.minimum(returns, 0) ** 2)) if len(returns) else 0.0
    return float(returns.mean() / down) if down > 0 else 0.0


def rolling_days(rows: DataFrame, key: str, day: str, value: str, days: int, least: int = 2) -> DataFrame:
    """``rows`` with mean, deviation and dispersion (deviation over absolute mean) of the value over the trailing calendar days
    of the key, the row's own day included. Rows of one day see each other."""
    w = Window.partitionBy(key).orderBy(day).rangeBetween(-(days - 1), 0)
    n, m, s = F.count(value).over(w), F.avg(value).over(w), F.stddev_samp(value).over(w)
    return rows.withColumns({"mean": F.when(n >= least, m), "sd": F.when(n >= least, s), "dispersion": F.when((n >= least) & (F.abs(m) > 1e-12), s / F.when(F.abs(m) > 1e-12, F.abs(m)))})


def asof_coverage(panel: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One row: where the first value lies in a key's history (median share), and the share of values in the first half, the last
    half and the last row: a source that was lost shows as a late start or an empty end."""
    w = Window.partitionBy(key)
    at = F.row_number().over(w.orderBy(order))
    own = panel.withColumns({"_at": at, "_n": F.count(F.lit(1)).over(w)})
    per = own.groupBy(key).agg(F.min(F.when(F.col(value).isNotNull(), (F.col("_at") - 1) / F.col("_n"))).alias("_first"))
    held = F.col(value).isNotNull().cast("double")
    out = own.agg(F.avg(F.when(F.col("_at") * 2 <= F.col("_n"), held)).alias("early"), F.avg(F.when(F.col("_at") * 2 > F.col("_n"), held)).alias("late"), F.avg(F.when(F.col("_at") == F.col("_n"), held)).alias("last"))
    met = per.agg(F.percentile("_first", F.lit(0.5)).alias("first")).unionByName(out, allowMissingColumns=True)
    return met.agg(*(F.max(c).alias(c) for c in ("first", "early", "late", "last")))


def limited_fill(value: str, key: str, order: str, limit: int) -> Column:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-limit, 0)
    return F.last(value, ignorenulls=True).over(w)


def calendar_series(series: DataFrame, days: DataFrame, order: str, value: str) -> DataFrame:
    """Every session of the calendar between the series' ends, missing ones as null slots."""
    ends = series.agg(F.min(order), F.max(order)).first()  # one row
    grid = days.select(order).filter(F.col(order).between(ends[0], ends[1]))
    return grid.join(series.select(order, value), order, "left")
