"""Attributes as they were known at an event's time, by one sweep over an entity's days."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import LAST_DAY


#: A day before all others, for rows of which none is known.
NEVER = -(1 << 31)


class InForce:
    """The rows in force that may still count, least rank first. A row that ends no later than one of greater rank never
    counts again and is not kept, so that ends fall strictly and there are at most as many rows as days."""

    __slots__ = ("ranks", "last", "at")

    def __init__(self) -> None:
        self.ranks: list[tuple] = []
        self.last: list[int] = []
        self.at: list[int] = []

    def insert(self, rank: tuple, last: int, at: int) -> None:
        i = j = bisect_right(self.ranks, rank)
        if i < len(self.last) and self.last[i] >= last:
            return
        while j and self.last[j - 1] <= last:
            j -= 1
        self.ranks[j:i], self.last[j:i], self.at[j:i] = [rank], [last], [at]

    def greatest(self, day: int) -> int | None:
        """Which row counts on ``day``; days must come in order."""
        while self.last and self.last[-1] < day:
            self.ranks.pop(), self.last.pop(), self.at.pop()
        return self.at[-1] if self.at else None

    def clear(self) -> None:
        self.ranks, self.last, self.at = [], [], []


def attributes_at(events: DataFrame, attributes: DataFrame, entity: str, day: str, valid_from: Column, valid_to: Column, known: Column, wide: list[str], ties: list[Column]) -> DataFrame:
    """``events`` (every row and column) with the struct ``attrs`` (``wide``) of the attributes known and in force on ``day``.

    A row of ``attributes`` is in force from the later of its start and the day it became known until its end. Rows with
    a null start or an end before that day are never in force. Of several in force the one with the latest start counts,
    then the latest known day (null is earliest), then the greatest of ``ties``. Events with a null entity or day, or of a
    day without attributes, keep a null ``attrs``. Repeated events stay repeated.

    Events and attributes meet in one shuffle by entity, sorted by day, and nothing is multiplied by the days it spans. In
    memory are a batch and the rows of one entity that may still count, at most one for each day of the calendar.
    """
    rows = attributes.select(
        F.col(entity),
        F.greatest(valid_from, F.coalesce(known, valid_from)).alias("_day"),
        F.lit(False).alias("_asks"),
        F.coalesce(valid_to, F.lit(LAST_DAY)).alias("_last"),
        valid_from.alias("_r0"),
        F.coalesce(known, F.lit(NEVER)).alias("_r1"),
        *(t.alias(f"_r{i}") for i, t in enumerate(ties, 2)),
        F.struct(*wide).alias("_attrs"),
    )
    kind, ranks = rows.schema["_attrs"].dataType, [f"_r{i}" for i in range(len(ties) + 2)]
    both = events.withColumns({"_day": F.col(day), "_asks": F.lit(True)}).unionByName(rows, allowMissingColumns=True)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kept, key = InForce(), None, None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            # rows that are never in force; a filter in the plan would have every date parsed once more for it
            sound = pc.and_(pc.and_(own.column(entity).is_valid(), own.column("_r0").is_valid()), pc.less_equal(own.column("_day"), own.column("_last")).fill_null(False))
            own = own.filter(pc.or_(own.column("_asks"), sound))
            if not own.num_rows:
                continue
            table = own if kept is None else pa.concat_tables([kept, own])
            code = own.column(entity).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            heads = np.concatenate([[own.column(entity)[0].as_py() != key], np.diff(code) != 0]).tolist()
            asks, days, last = own.column("_asks").to_pylist(), own.column("_day").to_pylist(), own.column("_last").to_pylist()
            dated = own.filter(pc.invert(own.column("_asks"))).select(ranks)
            # null is least among the ties
            order = zip(dated.column(0).to_pylist(), dated.column(1).to_pylist(), *([(v is not None, v) if v is not None else (False,) for v in c.to_pylist()] for c in dated.columns[2:]))
            found: list[int | None] = []
            for at, (head, ask, now, end) in enumerate(zip(heads, asks, days, last), table.num_rows - own.num_rows):
                if head:
                    state.clear()
                if not ask:
                    state.insert(next(order), end, at)
                else:
                    found.append(None if now is None else state.greatest(now))
            if found:
                out = own.filter(own.column("_asks")).select(names)
                yield from out.append_column("attrs", table.column("_attrs").combine_chunks().take(pa.array(found, pa.int64()))).to_batches()
            key = own.column(entity)[-1].as_py()
            kept = table.take(pa.array(state.at, pa.int64())) if state.at else None
            state.at = list(range(len(state.at)))

    names = events.columns
    schema = T.StructType([*events.schema.fields, T.StructField("attrs", kind)])
    # numbered, because the little that is shuffled here is much work; events without an entity are spread by their day
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = both.repartition(parts, F.when(F.col(entity).isNotNull(), F.xxhash64(entity)).otherwise(F.xxhash64("_day")))
    return placed.sortWithinPartitions(entity, "_day", "_asks").mapInArrow(sweep, schema)
