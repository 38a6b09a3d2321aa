"""Totals over trailing calendar periods, days without a row included, by banded matrices over tiles of days.

Rows (entity, day, measures) go to the tile of their day and, where they lie less than a period before the next tile,
to that tile too: its halo. A task gets one block of entities in one tile, packs it into a dense entities-by-days matrix
for each measure and multiplies it by one banded 0/1 matrix for each period. No entity's history is ever in one place, and no
window runs over rows. A group holds at most one row per entity and day, so its size is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 128
BLOCK = 64


def _bands(periods: list[int], halo: int, tile: int) -> list[np.ndarray]:
    """For each period a matrix that sums, for day j of the tile, the days j-period+1..j; row 0 is the first halo day."""
    source, target = np.arange(halo + tile)[:, None], np.arange(tile)[None, :] + halo
    return [((source <= target) & (source > target - n)).astype(float) for n in periods]


def trailing_totals(rows: DataFrame, spans: DataFrame, entity: str, day: str, measures: list[str], periods: list[int], tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """One row for every entity and every day of its span: entity, day, ``day_no`` (1 on its first day) and, for each
    measure and period n, ``{measure}_{n}``: the total of the n days that end with the day. Averages are totals over n.

    ``rows`` has at most one row for an entity and day (aggregate repeated rows first); measures that are null, NaN or
    infinite and absent days count as 0. ``spans`` has entity, ``first``, ``last`` (day numbers, both included), one row
    for an entity; entities without a span, or with a null one, have no rows out. Rows before the span count in its
    periods; rows after it don't matter. Null entities are no entity. Periods are at most a tile long.
    """
    halo = max(periods) - 1
    if halo > tile:
        raise ValueError("a period must not be longer than a tile")
    spans = spans.select(F.col(entity), "first", "last").filter(F.col(entity).isNotNull() & (F.col("first") <= F.col("last")))
    n = spans.agg(F.approx_count_distinct(entity)).first()[0]
    blocks = max(1, n // block)
    home = F.pmod(F.xxhash64(entity), F.lit(blocks)).cast("int").alias("_block")
    none = [F.lit(None).cast("double").alias(m) for m in measures]
    # A mark carries the entity's span into each tile that it touches.
    marks = spans.select(
        home, F.explode(F.sequence(F.floor(F.col("first") / tile).cast("int"), F.floor(F.col("last") / tile).cast("int"))).alias("_tile"),
        F.col(entity), F.lit(None).cast("int").alias("_day"), F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), *none,
    )
    own = F.floor(F.col(day) / tile).cast("int")
    into = F.when(F.col(day) % tile >= tile - halo, F.array(own, own + 1)).otherwise(F.array(own))
    facts = rows.filter(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(
        home, F.explode(into).alias("_tile"), F.col(entity), F.col(day).cast("int").alias("_day"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), *(F.col(m).cast("double").alias(m) for m in measures),
    )
    names = [f"{m}_{p}" for m in measures for p in periods]
    key = rows.schema[entity].dataType
    schema = T.StructType([T.StructField(entity, key), T.StructField(day, T.IntegerType()), T.StructField("day_no", T.IntegerType()), *(T.StructField(x, T.DoubleType()) for x in names)])
    bands = _bands(periods, halo, tile)

    def dense(table: pa.Table) -> pa.Table:
        names_ = table.column(entity).combine_chunks().dictionary_encode()
        codes, keys = names_.indices.to_numpy(zero_copy_only=False), names_.dictionary
        first = table.column("first").fill_null(-1).to_numpy()
        mark = first >= 0
        lo, hi = np.zeros(len(keys), int), np.full(len(keys), -1)
        lo[codes[mark]], hi[codes[mark]] = first[mark], table.column("last").fill_null(-1).to_numpy()[mark]
        start = table.column("_tile")[0].as_py() * tile
        at = codes[~mark], table.column("_day").fill_null(0).to_numpy()[~mark] - start + halo
        days = start + np.arange(tile)
        keep = (days[None, :] >= lo[:, None]) & (days[None, :] <= hi[:, None])
        e, d = np.nonzero(keep)
        out = [keys.take(pa.array(e)), pa.array((start + d).astype(np.int32)), pa.array((start + d - lo[e] + 1).astype(np.int32))]
        for m in measures:
            grid = np.zeros((len(keys), halo + tile))
            grid[at] = np.nan_to_num(table.column(m).fill_null(0.0).to_numpy()[~mark], nan=0.0, posinf=0.0, neginf=0.0)
            out += [pa.array((grid @ band)[e, d]) for band in bands]
        return pa.table(dict(zip([entity, day, "day_no", *names], out)))

    return facts.unionByName(marks).groupBy("_block", "_tile").applyInArrow(dense, schema)
