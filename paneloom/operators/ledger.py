"""History of an entity's attributes with valid and recorded time (a bitemporal ledger).

Filings are written into the ledger in the order in which they were recorded. Each one splits the periods it overlaps
where it ranks higher than what was believed there: what was believed gets an end of its recorded time and stays in
the ledger, never overwritten. The valid axis is cut into tiles, so that an entity with very many filings is spread over
tasks; within a tile, filings that cannot be told apart were collapsed before the shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import LAST_DAY
from .keyed import keyed_scan

TILE_DAYS = 1024
#: Days from 2036-06 on are one tile, so that an open interval has a bounded number of pieces.
LAST_TILE = 48


class Ledger:
    """Beliefs of one entity over a stretch of valid time: disjoint ordered pieces (from, to, filing), and what they superseded."""

    def __init__(self) -> None:
        self.first: list[int] = []
        self.last: list[int] = []
        self.what: list[tuple] = []  # (rank, recorded day)
        self.closed: list[tuple] = []

    def record(self, a: int, b: int, rank: tuple, at: int) -> None:
        """Sweeps the pieces that a..b overlaps; takes the days that are free or held by a lower rank."""
        i, j = bisect_left(self.last, a), bisect_right(self.first, b)
        pieces, at_day = [], a
        for k in range(i, j):
            x, y, held = self.first[k], self.last[k], self.what[k]
            if x > at_day:
                pieces.append((at_day, x - 1, (rank, at)))
            lo, hi = max(x, a), min(y, b)
            if held[0] >= rank:
                pieces.append((x, y, held))
            else:
                self.closed.append((lo, hi, *held, at))
                if x < lo:
                    pieces.append((x, lo - 1, held))
                pieces.append((lo, hi, (rank, at)))
                if hi < y:
                    pieces.append((hi + 1, y, held))
            at_day = max(at_day, hi + 1)
        if at_day <= b:
            pieces.append((at_day, b, (rank, at)))
        self.first[i:j], self.last[i:j], self.what[i:j] = [p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces]

    def rows(self) -> list[tuple]:
        """(valid from, valid to, rank, recorded from, recorded to or None); superseded within its own day: left out."""
        closed = [(a, b, r, s, e) for a, b, r, s, e in self.closed if e > s]
        return closed + [(a, b, r, s, None) for a, b, (r, s) in zip(self.first, self.last, self.what)]


def bitemporal_ledger(filings: DataFrame, entity: str, first: str, last: str, known: str, number: str, value: str, begin: str | None = None) -> DataFrame:
    """Rows (entity, ``valid_from``, ``valid_to``, ``recorded_from``, ``recorded_to``, ``number``, ``value``): what was believed of
    which days, when. A null ``recorded_to`` marks present belief. Days are integers, ends are included.

    On a day the filing with the latest ``first`` counts, then the latest ``known`` (null is earliest), then the greatest
    ``number``. It is recorded on its known day, or on its first day where that is null. Filings with a null entity, a null
    first day or last < first are ignored; a null last is open (LAST_DAY). Repeated filings count once, the greatest
    number of them. ``begin`` names a column with the day from which a filing may hold where that isn't its first day, as when
    intervals are cut to a listing. Pieces are cut at tile bounds; ``periods`` joins them.
    """
    a, b = F.col(first), F.coalesce(F.col(last), F.lit(LAST_DAY))
    rows = filings.select(F.col(entity), a.cast("int").alias("_s"), b.cast("int").alias("_e"), F.col(known).cast("int").alias("_k"), F.col(number).cast("long").alias("_n"), F.col(value).alias("_v"), F.coalesce(F.col(begin or first), a).cast("int").alias("_f"))
    rows = rows.filter(F.col(entity).isNotNull() & F.col("_s").isNotNull() & (F.col("_f") <= F.col("_e")))
    rows = rows.groupBy(entity, "_s", "_f", "_e", "_k").agg(F.max(F.struct("_n", "_v")).alias("_x"))
    tile = lambda c: F.least(F.floor(c / TILE_DAYS), F.lit(LAST_TILE)).cast("int")
    tiled = rows.withColumn("_tile", F.explode(F.sequence(tile(F.col("_f")), tile(F.col("_e")))))
    lo = F.greatest(F.col("_f"), F.col("_tile") * TILE_DAYS)
    hi = F.when(F.col("_tile") < LAST_TILE, F.least(F.col("_e"), (F.col("_tile") + 1) * TILE_DAYS - 1)).otherwise(F.col("_e"))
    # Of filings with one period in the tile that were recorded on one day, only the highest can ever be believed.
    rec = F.coalesce("_k", "_s")
    tiled = tiled.groupBy(entity, "_tile", lo.alias("_a"), hi.alias("_b"), rec.alias("_r")).agg(
        F.max(F.struct("_s", F.coalesce("_k", F.lit(-(1 << 30))).alias("_k"), F.col("_x._n").alias("_n"), F.col("_x._v").alias("_v"))).alias("_x")
    ).select(entity, "_tile", "_a", "_b", "_r", "_x._s", "_x._k", "_x._n", "_x._v")
    kinds = dict(filings.dtypes)

    def take(state: tuple, row: tuple) -> None:
        ledger, values = state
        _, _, x, y, r, s, k, n, v = row
        values[s, k, n] = v
        ledger.record(x, y, (s, k, n), r)

    def finish(key: tuple, state: tuple) -> list[tuple]:
        ledger, values = state
        return [(key[0], x, y, f, t, rank[2], values[rank]) for x, y, rank, f, t in ledger.rows()]

    schema = f"`{entity}` {kinds[entity]}, valid_from int, valid_to int, recorded_from int, recorded_to int, number long, value {kinds[value]}"
    return keyed_scan(tiled, [entity, "_tile"], ["_r", "_s", "_k", "_n"], lambda: (Ledger(), {}), take, finish, schema)


def periods(pieces: DataFrame, entity: str, value: str, first: str, last: str) -> DataFrame:
    """Joins touching pieces of one value: (entity, value, first, last), maximal runs. Pieces of an entity are disjoint,
    so that there are at most as many as days; null values equal each other."""
    w = Window.partitionBy(entity).orderBy(first)
    new = F.coalesce((F.lag(last).over(w) + 1 != F.col(first)) | ~F.lag(value).over(w).eqNullSafe(F.col(value)), F.lit(True))
    runs = pieces.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(entity, "_run").agg(F.first(value).alias(value), F.min(first).alias(first), F.max(last).alias(last)).drop("_run")


def believed_at(ledger: DataFrame, day: Column | int) -> DataFrame:
    """Ledger rows believed at the end of a day."""
    day = F.lit(day) if isinstance(day, int) else day
    return ledger.filter((F.col("recorded_from") <= day) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > day)))
