"""Merging of overlapping day intervals and the gaps between them, with an ordered map of disjoint intervals for each entity.

The union of intervals is associative, so the map is kept twice: in each partition before the shuffle, over whatever
rows of an entity are there, and for each entity after it, over those disjoint parts. The hot entity's rows are thus
merged where they lie; what is shuffled of an entity is at most one interval for two days of the calendar and partition.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LAST_DAY
from .keyed import keyed_scan


class IntervalMap:
    """Ordered disjoint closed intervals of integers; neighbours that touch (an end the day before a start) are one."""

    __slots__ = ("first", "last")

    def __init__(self, first: list[int] | None = None, last: list[int] | None = None) -> None:
        self.first, self.last = first or [], last or []

    def insert(self, a: int, b: int) -> None:
        """Adds a..b. Those it overlaps or touches are found by binary search and become one with it; b < a adds nothing."""
        if b < a:
            return
        i, j = bisect_left(self.last, a - 1), bisect_right(self.first, b + 1)
        if i < j:
            a, b = min(a, self.first[i]), max(b, self.last[j - 1])
        self.first[i:j], self.last[i:j] = [a], [b]

    def gaps(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Maximal uncovered periods within lo..hi."""
        out, at = [], lo
        for a, b in zip(self.first, self.last):
            if b < lo:
                continue
            if a > hi:
                break
            if a > at:
                out.append((at, a - 1))
            at = b + 1
        if at <= hi:
            out.append((at, hi))
        return out

    def clipped(self, lo: int, hi: int) -> list[tuple[int, int]]:
        return [(max(a, lo), min(b, hi)) for a, b in zip(self.first, self.last) if a <= hi and b >= lo]


def _premerged(entity: str):
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps: dict = {}
        for batch in batches:
            for key, a, b in zip(batch[entity], batch["_a"].tolist(), batch["_b"].tolist()):
                maps.setdefault(key, IntervalMap()).insert(a, b)
            if len(maps) > 200_000:  # keeps the task's memory bounded; the rest is merged after the shuffle
                yield _rows(entity, maps)
                maps = {}
        if maps:
            yield _rows(entity, maps)

    return merge


def _rows(entity: str, maps: dict) -> pd.DataFrame:
    flat = [(k, a, b) for k, m in maps.items() for a, b in zip(m.first, m.last)]
    return pd.DataFrame(flat, columns=[entity, "_a", "_b"])


def coverage(intervals: DataFrame, spans: DataFrame, entity: str, first: str, last: str, lo: str, hi: str) -> DataFrame:
    """Rows (entity, ``kind``, ``from_day``, ``to_day``): ``covered`` periods and ``gap`` periods of each entity of ``spans``
    within its span lo..hi, ends included. Days are integers.

    An interval with a null first day or with last < first is ignored, a null last is open. A span has one row for an
    entity; with a null lo it has no begin, so nothing before the first interval is a gap; a null hi is open; hi < lo is
    an empty span without rows. Entities without a span, and null entities, are left out; those without intervals are
    one gap.
    """
    a, b = F.col(first), F.coalesce(F.col(last), F.lit(LAST_DAY))
    key = F.col(entity)
    rows = intervals.filter(key.isNotNull() & a.isNotNull() & (a <= b)).select(key, a.cast("long").alias("_a"), b.cast("long").alias("_b"))
    kind = dict(intervals.dtypes)[entity]
    parts = rows.mapInPandas(_premerged(entity), f"`{entity}` {kind}, _a long, _b long")
    ends = spans.filter(key.isNotNull()).groupBy(key).agg(F.min(lo).cast("long").alias("_a"), F.max(F.coalesce(F.col(hi), F.lit(LAST_DAY))).cast("long").alias("_b"))
    met = ends.withColumn("_what", F.lit(0)).unionByName(parts.withColumn("_what", F.lit(1)))

    def take(state: list, row: tuple) -> None:
        _, x, y, what = row
        if what:
            state[0].insert(int(x), int(y))
        else:
            state[1] = (x, int(y))

    def settle(group: tuple, state: list) -> list[tuple]:
        own, span = state
        if span is None:
            return []
        start, end = span
        start = (own.first[0] if own.first else end + 1) if start is None else int(start)
        if start > end:
            return []
        found = [("covered", x, y) for x, y in own.clipped(start, end)] + [("gap", x, y) for x, y in own.gaps(start, end)]
        return [(group[0], *r) for r in found]

    schema = f"`{entity}` {kind}, kind string, from_day int, to_day int"
    return keyed_scan(met, [entity], ["_what", "_a"], lambda: [IntervalMap(), None], take, settle, schema)
