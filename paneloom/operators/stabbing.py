"""Which interval is in force on a day: a distributed interval tree made of equal keys.

A day range is cut into dyadic blocks (a level and an index: 2**level days each, at most two a level), a day belongs to
one block of each level. "Greatest row among the intervals that hold the day" is then an equi-join and a maximum; both
sides aggregate before they shuffle, so that an entity with very many intervals is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY_BITS, LAST_DAY

_SHIFT = 32


def _blocks(first: Column, last: Column) -> Column:
    """Array of block ids (level * 2**32 + index) that make up first..last, both included."""
    out = []
    for level in range(DAY_BITS + 1):
        size = 1 << level
        lo, hi = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")
        tag = level << _SHIFT
        out.append(F.when((lo < hi) & (lo % 2 == 1), lo + tag))
        out.append(F.when((lo < hi) & (hi % 2 == 1), hi - 1 + tag))
    return F.array_compact(F.array(*out))


def _ancestors(day: Column) -> Column:
    return F.array(*(F.shiftright(day.cast("long"), level) + (level << _SHIFT) for level in range(DAY_BITS + 1)))


def greatest_in_force(points: DataFrame, intervals: DataFrame, entity: str, day: str, first: str, last: str, rank: str) -> DataFrame:
    """``points`` (distinct entity, day) with the greatest ``rank`` (any orderable type) of the intervals of the entity
    that hold the day; points that no interval holds are left out. Intervals with a null bound or last < first hold no day."""
    cut = intervals.filter((F.col(first) <= F.col(last)) & F.col(entity).isNotNull()).withColumn(last, F.least(F.col(last), F.lit(LAST_DAY)))
    best = cut.groupBy(entity, first, last).agg(F.max(rank).alias(rank))
    best = best.select(entity, F.explode(_blocks(F.col(first), F.col(last))).alias("_block"), rank).groupBy(entity, "_block").agg(F.max(rank).alias(rank))
    asked = points.select(entity, day, F.explode(_ancestors(F.col(day))).alias("_block"))
    return asked.join(best, [entity, "_block"]).groupBy(entity, day).agg(F.max(rank).alias(rank))
