"""Relational work on panels: as-of joins, deduplication, cleaning, sampling, resampling, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# As-of joins


def asof(left: DataFrame, right: DataFrame, key: str, at: str, since: str, values: list[str], ties: list[str] = (), tolerance: int | None = None, strict: bool = False, tile: int = 512) -> DataFrame:
    """``left`` (every row and column) with ``values`` of the latest row of ``right`` of the same key with ``since`` <= ``at`` (< if
    ``strict``) and its ``since``; null where there is none or it is more than ``tolerance`` days old. Days are integers.

    Of right rows of one day the greatest by ``ties`` counts. Both sides are cut into tiles of days: what a tile inherits is
    the last row before it, one row a key and tile, so that a key with very many rows is many tasks. Null keys and null
    days match nothing; nulls among the values are values.
    """
    own = right.filter(F.col(key).isNotNull() & F.col(since).isNotNull())
    best = own.groupBy(F.col(key).alias("_k"), F.col(since).alias("_t")).agg(F.max(F.struct(*ties, *values)).alias("_v"))
    best = best.select("_k", "_t", F.struct(F.col("_t").alias("_since"), *(F.col(f"_v.{v}").alias(v) for v in values)).alias("_v"))
    bucket = lambda c: F.floor(c / tile).cast("int")
    ends = best.groupBy("_k", bucket(F.col("_t")).alias("_b")).agg(F.max("_v").alias("_carry"))
    asked = left.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t")).distinct()
    tiles = asked.select("_k", bucket(F.col("_t")).alias("_b")).distinct().withColumn("_want", F.lit(1))
    chain = ends.withColumn("_want", F.lit(0)).unionByName(tiles, allowMissingColumns=True)
    chain = chain.groupBy("_k", "_b").agg(F.max("_carry").alias("_carry"), F.max("_want").alias("_want"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for a tile, not for a fact
    chain = chain.withColumn("_carry", F.last("_carry", ignorenulls=True).over(before)).filter("_want = 1").drop("_want")
    # facts first on their own day unless the match is strict
    both = best.select("_k", "_t", F.lit(1 if strict else 0).alias("_side"), "_v").unionByName(asked.select("_k", "_t", F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(best.schema["_v"].dataType).alias("_v")))
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_b", bucket(F.col("_t"))).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    answer = both.filter(F.col("_side") == (0 if strict else 1)).join(chain, ["_k", "_b"], "left").select("_k", "_t", F.coalesce("_v", "_carry").alias("_v"))
    if tolerance is not None:
        answer = answer.withColumn("_v", F.when(F.col("_t") - F.col("_v._since") <= tolerance, F.col("_v")))
    met = left.join(answer, (left[key] == answer["_k"]) & (left[at] == answer["_t"]), "left")
    return met.select(*(left[c] for c in left.columns), F.col("_v._since").alias(since), *(F.col(f"_v.{v}").alias(v) for v in values))


def visible_at(rows: DataFrame, keys: list[str], value: str, available: str, clock: Column) -> DataFrame:
    """Bitemporal read: each key's value of the latest revision that was available at ``clock``; a null revision wins like any
    other; keys without one are left out."""
    return rows.filter(F.col(available) <= clock).groupBy(*keys).agg(F.max_by(value, available).alias(value))


# Deduplication and cleaning


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``, as one struct maximum combined before the shuffle; nulls come first."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("_row"))).alias("_m"))
    return best.select(*keys, *(F.col(f"_m._row.{c}").alias(c) for c in rest))


def agreed_or_null(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for a key: values on which its rows agree (a null beside a value is a conflict), else null."""
    same = lambda v: (F.min(v).eqNullSafe(F.max(v))) & ((F.count(v) == 0) | (F.count(v) == F.count(F.lit(1))))
    return rows.groupBy(*keys).agg(*(F.when(same(v), F.max(v)).alias(v) for v in values))


def winsorised(rows: DataFrame, value: str, by: list[str], lo: float = 0.01, hi: float = 0.99, least: int = 1) -> Column:
    """``value`` held within its quantiles over the groups ``by``; groups with fewer values are left as they are."""
    w = Window.partitionBy(*by)
    a, b = F.percentile(value, F.lit(lo)).over(w), F.percentile(value, F.lit(hi)).over(w)
    return F.when(F.count(value).over(w) < least, F.col(value)).when(F.col(value).isNotNull(), F.greatest(a, F.least(b, F.col(value))))


def filled_forward(value: str, key: str, order: str, limit: int | None = None) -> Column:
    """The last value that isn't null, at most ``limit`` rows back."""
    w = Window.partitionBy(key).orderBy(order)
    frame = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return F.last(value, ignorenulls=True).over(frame)


def filled_backward(value: str, key: str, order: str) -> Column:
    w = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def adjusted(panel: DataFrame, prices: list[str], factor: str, key: str = "ts_code", order: str = "idx") -> DataFrame:
    """Prices times their adjustment factor; a missing factor is that of the next session that has one, else 1."""
    f = F.coalesce(F.col(factor), filled_backward(factor, key, order), F.lit(1.0))
    panel = panel.withColumn("_f", f)
    return panel.withColumns({p: F.col(p) * F.col("_f") for p in prices}).drop("_f")


BOARDS = (("^(600|601|603|605)", "main_sh"), ("^(688|689)", "star"), ("^(000|001|002|003)", "main_sz"), ("^(300|301)", "growth"), (r"\.BJ$", "beijing"))


def board(code: Column) -> Column:
    """Market board of a code, null if none fits."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(BOARDS):
        out = F.when(code.rlike(pattern), name).otherwise(out)
    return out


def hash_sample(rows: DataFrame, key: str, by: str, salt: str, n: int) -> DataFrame:
    """The ``n`` keys of each group with the least sha256 of ``salt:key``: the same keys in every run and on every cluster."""
    keys = rows.select(by, key).distinct().withColumn("_h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key)), 256))
    return keys.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h", key))).filter(F.col("_r") <= n).drop("_r", "_h")


def top_by_mean(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The ``n`` keys with the greatest mean of ``value``; ties by key."""
    return rows.groupBy(key).agg(F.avg(value).alias("mean")).filter(F.col("mean").isNotNull()).orderBy(F.col("mean").desc(), key).limit(n)


def overlay(base: DataFrame, newer: DataFrame, date: str) -> DataFrame:
    """Rows of ``newer`` replace all rows of ``base`` on their dates."""
    return base.join(newer.select(date).distinct(), date, "left_anti").unionByName(newer)


def aligned_sum(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Outer alignment with 0 where a part has no row: one union and sum, however many parts there are."""
    out = parts[0].select(*keys, value)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys, value))
    return out.groupBy(*keys).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias(value))


def same_members(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: members of ``a`` only, of ``b`` only, of both."""
    met = a.select(*keys).distinct().withColumn("_a", F.lit(1)).unionByName(b.select(*keys).distinct().withColumn("_a", F.lit(2))).groupBy(*keys).agg(F.sum("_a").alias("_in"))
    n = lambda v: F.sum(F.when(F.col("_in") == v, 1).otherwise(0))
    return met.agg(F.coalesce(n(1), F.lit(0)).alias("only_a"), F.coalesce(n(2), F.lit(0)).alias("only_b"), F.coalesce(n(3), F.lit(0)).alias("both"))


# Resampling


def week_end(date: Column) -> Column:
    """The Sunday that ends the date's week."""
    return F.date_add(F.date_trunc("week", date).cast("date"), 6)


def weekly_bars(panel: DataFrame, date: Column) -> DataFrame:
    """Weekly bars of dense daily ones: first open, high, low, last close, sums; a week without any value is null, not 0."""
    rows = panel.withColumn("_d", date).withColumn("week", week_end(F.col("_d")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_d")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_d")))
    return rows.groupBy("ts_code", "week").agg(
        first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")
    )


def single_quarters(rows: DataFrame, key: str, year: str, quarter: str, value: str) -> DataFrame:
    """``single``: a cumulative value less that of the quarter before in the same year (the first quarter as it is), and ``ttm``:
    the sum of four complete quarters in a row."""
    w = Window.partitionBy(key, year).orderBy(quarter)
    before = F.when(F.lag(quarter).over(w) == F.col(quarter) - 1, F.lag(value).over(w))
    rows = rows.withColumn("single", F.when(F.col(quarter) == 1, F.col(value)).otherwise(F.col(value) - before))
    at = Window.partitionBy(key).orderBy(F.col(year) * 4 + F.col(quarter))
    frame = at.rowsBetween(-3, 0)
    whole = (F.count("single").over(frame) == 4) & (F.max(F.col(year) * 4 + F.col(quarter)).over(frame) - F.min(F.col(year) * 4 + F.col(quarter)).over(frame) == 3)
    return rows.withColumn("ttm", F.when(whole, F.sum("single").over(frame)))


def event_window(grid: DataFrame, events: DataFrame, key: str, at: str, value: str, n: int, how: str = "sum", wait: int = 1) -> DataFrame:
    """``grid`` with ``{value}_{how}_{n}``: over the events of the last ``n`` grid positions (no fill; 0 without any), known ``wait``
    positions later. ``at`` is the grid's dense position."""
    per = events.groupBy(key, at).agg(F.sum(value).alias("_s"), F.max(value).alias("_m"), F.count(value).alias("_n"))
    met = grid.join(per, [key, at], "left")
    w = Window.partitionBy(key).orderBy(at)
    frame = w.rowsBetween(-(n - 1), 0)
    held = {"sum": F.sum("_s"), "max": F.max("_m"), "count": F.sum("_n"), "mean": F.sum("_s")}[how].over(frame)
    if how == "mean":
        held = held / F.when(F.sum("_n").over(frame) > 0, F.sum("_n").over(frame))
    met = met.withColumn("_v", F.coalesce(held.cast("double"), F.lit(0.0)))
    return met.withColumn(f"{value}_{how}_{n}", F.lag("_v", wait).over(w)).drop("_v", "_s", "_m", "_n")


def market_breadth(panel: DataFrame) -> DataFrame:
    """By session: names, names at their upper limit, share that opened above the close before, and the mean open-to-open
    premium of the names that were at their limit the session before."""
    w = Window.partitionBy("ts_code").orderBy("idx")
    at_limit = F.coalesce(F.col("close") >= F.col("up_limit") - 0.005, F.lit(False))
    rows = panel.withColumns({"_l": at_limit, "_prev": F.lag("close").over(w)})
    rows = rows.withColumn("_was", F.coalesce(F.lag("_l").over(w), F.lit(False))).filter(F.col("close").isNotNull())
    gap = F.when(F.col("_prev") > 0, F.col("open") / F.col("_prev") - 1)
    return rows.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("names"), F.sum(F.col("_l").cast("int")).alias("limit_up"), F.avg((gap > 0).cast("double")).alias("open_up"), F.avg(F.when(F.col("_was"), gap)).alias("premium")
    )


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
