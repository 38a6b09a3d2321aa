"""Implausible readings of a source, judged against the source's own normal behaviour.

The normal range of a source comes from KLL quantile sketches, one for each source and context (the day of the week,
the context that daily readings have), built partially in every partition, merged across partitions and, where a
context has few readings, across contexts. A reading is flagged if it is impossible, if it leaves the expanded
interquartile fences at an implausible rate and the readings soon return to the level before it, or if it belongs to
a run without variance. Windows run over one row for a source and day, so a source's group is bounded by the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import FILLERS

SKETCH_K = 256
#: Readings that a context must have to be judged by its own sketch.
CONTEXT_LEAST = 120
STUCK_RUN = 5


def _median3(a: Column, b: Column, c: Column) -> Column:
    """Median of those of three that are not null, which come first."""
    return F.when(c.isNotNull(), a + b + c - F.greatest(a, b, c) - F.least(a, b, c)).when(b.isNotNull(), (a + b) / 2).otherwise(a)


def weekday_context(day: Column) -> Column:
    return F.coalesce(F.pmod(day, F.lit(7)), F.lit(-1))


def with_normal_ranges(rows: DataFrame, source: str, day: str, values: dict[str, tuple[Column, float]]) -> DataFrame:
    """``rows`` with ``_lo_{name}`` and ``_hi_{name}``: the interquartile range of each value for the row's source and context,
    expanded on either side by the given multiple. ``rows`` is read twice and should be a written table."""
    context = weekday_context(F.col(day)).alias("_ctx")
    sketch = [F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias(n) for n, (v, _) in values.items()]
    parts = rows.groupBy(F.col(source).alias("_src"), context).agg(*sketch)
    merged = parts.groupBy("_src").agg(
        *(F.kll_merge_agg_double(n).alias(f"_all_{n}") for n in values),
        *(F.map_from_entries(F.collect_list(F.struct("_ctx", n))).alias(f"_by_{n}") for n in values),
    )
    # quartiles of a source, and of each context that has enough readings of its own
    q = lambda sk: F.array(*(F.kll_sketch_get_quantile_double(sk, F.lit(p)) for p in (0.25, 0.75)))
    some = lambda sk, least: F.coalesce(F.kll_sketch_get_n_double(sk), F.lit(0)) >= least
    ranges = merged.select("_src", *(c for n in values for c in (
        F.when(some(F.col(f"_all_{n}"), 1), q(F.col(f"_all_{n}"))).alias(f"_q_{n}"),
        F.transform_values(F.map_filter(f"_by_{n}", lambda _, sk: some(sk, CONTEXT_LEAST)), lambda _, sk: q(sk)).alias(f"_m_{n}"),
    )))
    met = rows.join(ranges, rows[source] == ranges["_src"], "left")  # rows without a source have no range
    bounds = {}
    for n, (_, expand) in values.items():
        own = F.coalesce(F.try_element_at(F.col(f"_m_{n}"), weekday_context(F.col(day))), F.col(f"_q_{n}"))
        width = own[1] - own[0]
        bounds |= {f"_lo_{n}": own[0] - width * expand, f"_hi_{n}": own[1] + width * expand}
    return met.withColumns(bounds).drop("_src", *(f"_{k}_{n}" for k in "qm" for n in values))


def impossible(value: Column, positive: bool) -> Column:
    bad = F.isnan(value) | (F.abs(value) == float("inf")) | F.abs(value).isin(*FILLERS)
    return F.coalesce(bad | (value <= 0) if positive else bad, F.lit(False))


def level_candidates(rows: DataFrame, source: str, day: str, value: str, before: Column | None = None, least: float = 0.12) -> DataFrame:
    """``rows`` with boolean ``_bad`` (impossible), ``_step`` (how far the logarithm lies off the level before) and ``_off`` (how
    far it lies off the levels around it, if that is implausible, else null), for a positive level such as a price.

    ``rows`` has one row for a source and day. A reading is off if its logarithm lies, on the same side and by more than
    ``least``, off the median of the three good readings before and of the three after it, and so do the reading just
    before and just after it (or, of two like readings side by side, the ones around both). Where no reading precedes,
    ``before`` (the reference price that the row quotes) stands in; a reading near a ``before`` that is itself off the last
    reading follows a reset of the level and is none. A last reading has nothing that it could return to and is none.
    """
    bad = impossible(F.col(value), positive=True)
    rows = rows.withColumns({"_bad": bad & F.col(value).isNotNull(), "_x": F.when(F.col(value).isNotNull() & ~bad, F.ln(value))})
    over = f"over (partition by `{source}` order by `{day}`)"
    near = {f"_{s}{k}": F.expr(f"{f}(_x, {k}) ignore nulls {over}") for s, f in (("p", "lag"), ("n", "lead")) for k in (1, 2, 3)}
    rows = rows.withColumns(near)
    quoted = F.when((before > 0) & ~F.isnan(before), F.ln(before)) if before is not None else F.lit(None).cast("double")
    x, p1, p2, p3, n1, n2, n3 = (F.col(c) for c in ("_x", "_p1", "_p2", "_p3", "_n1", "_n2", "_n3"))
    first = F.coalesce(p1, quoted)

    def off(a: Column, b: Column) -> Column:
        """How far x lies off both a and b, signed; 0 if between them."""
        up, down = F.least(x - a, x - b), F.greatest(x - a, x - b)
        return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(up > 0, up).when(down < 0, down).otherwise(F.lit(0.0))

    before3 = _median3(first, p2, p3)
    wide = off(before3, _median3(n1, n2, n3))
    close_by = F.greatest(F.abs(off(first, n1)), F.abs(off(first, n2)), F.abs(off(p2, n1)))
    reset = F.coalesce((F.abs(quoted - first) > 0.05) & (F.abs(quoted - x) < least), F.lit(False))
    rows = rows.withColumns({"_step": x - before3, "_off": F.when((F.abs(wide) > least) & (close_by > least) & ~reset, wide)})
    return rows.drop("_x", *near)


def leaves_range(value: Column, name: str) -> Column:
    """Whether a value lies outside its fences (:func:`with_normal_ranges`); null values and sources without readings don't."""
    return F.coalesce((value > F.col(f"_hi_{name}")) | (value < F.col(f"_lo_{name}")), F.lit(False))


def with_stuck(rows: DataFrame, source: str, day: str, values: list[str], moving: Column, least: int = STUCK_RUN) -> DataFrame:
    """``rows`` with boolean ``_stuck_{value}``: each reading after the first of a run of ``least`` or more equal readings on
    consecutive rows where ``moving`` is true. A null reading or a row that isn't moving ends a run."""
    w = Window.partitionBy(source).orderBy(day)
    go, n = F.coalesce(moving, F.lit(False)), least - 2
    rows = rows.withColumn("_go", go)
    same = {f"_same_{v}": F.coalesce((F.col(v) == F.lag(v).over(w)) & F.col("_go") & F.lag("_go").over(w), F.lit(False)) for v in values}
    rows = rows.withColumns(same)
    # least - 1 repetitions in a row end at some row from here on that still includes this one
    rows = rows.withColumns({f"_full_{v}": F.min(f"_same_{v}").over(w.rowsBetween(-n, 0)) for v in values})
    rows = rows.withColumns({f"_stuck_{v}": F.col(f"_same_{v}") & F.max(f"_full_{v}").over(w.rowsBetween(0, n)) for v in values})
    return rows.drop("_go", *same, *(f"_full_{v}" for v in values))


def rate_breaks(rows: DataFrame, source: str, day: str, rate: str, level: str, level_bad: str, before: str, change: str, least: float = 4.0) -> DataFrame:
    """``rows`` (with the fences of ``rate``) with boolean ``_rate_bad`` for a rate of change in percent that has a level beside it.

    A rate of -100 or less, NaN and filler numbers are impossible. A rate outside the fences of its source is borne out,
    and so no case, if it agrees with the change of the level from ``before`` or from the last good level; where the level
    of the row is itself flagged, a rate that follows that false level is a case and any other is none.
    """
    w = Window.partitionBy(source).orderBy(day)
    good = F.when(~F.col(level_bad) & F.col(level).isNotNull(), F.col(level))
    rows = rows.withColumn("_good", good)
    rows = rows.withColumn("_was", F.last("_good", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = F.col(rate)
    gain = lambda to, of: F.when((of > 0) & ~F.isnan(of), (to / of - 1) * 100)
    off = lambda *by: reduce(F.least, [F.coalesce(F.abs(r - g), F.lit(1e18)) for g in by])
    borne = off(gain(F.col("_good"), F.col(before)), gain(F.col("_good"), F.col("_was")))
    follows = off(gain(F.col(level), F.col(before)), gain(F.col(level), F.col("_was")))
    said = F.when(F.col(before) > 0, F.col(change) / F.col(before) * 100)
    apart = F.greatest(F.lit(least), F.abs(r) * 0.25)
    judged = (
        F.when(F.col(level).isNull(), (F.abs(r - said) > apart) | (said.isNull() & (F.abs(r) > 31)))
        .when(F.col(level_bad), (follows < 1) | ((F.abs(r - said) > apart) & (F.abs(r) > 12)))
        .otherwise(borne > apart)
    )
    wrong = impossible(r, False) | (r <= -100) | (leaves_range(r, rate) & judged)
    return rows.withColumn("_rate_bad", F.coalesce(wrong & r.isNotNull(), F.lit(False))).drop("_good", "_was")
