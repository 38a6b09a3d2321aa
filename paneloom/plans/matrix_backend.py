"""Nodes over blocks of instruments as numpy matrices (instrument by session), and over whole sessions, for batches of many signals.

A window column costs a pass over its frame for every row and a sort buffer for every specification. With dozens of windows
it is cheaper to sort an instrument's rows once and to take all windows of all signals from one matrix. Rows are
partitioned by instrument and come in Arrow batches; a block is as many whole instruments as make BLOCK rows, so memory is
bounded by a block and one instrument's calendar. NaN stands for null; sums are taken frame by frame, not as differences
of running totals, so that one huge reading leaves no trace once it is out of the frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nodes import Node
from .spark_backend import CROSS, TIME, TINY

BLOCK = 8_192
BACK = "_back"
Array = np.ndarray


def _either(a: Array, b: Array) -> Array:
    return np.isnan(a) | np.isnan(b)


def _told(truth: Array, unknown: Array) -> Array:
    return np.where(unknown, np.nan, truth.astype(float))


def _compare(f: Callable) -> Callable:
    return lambda a, b: _told(f(a, b), _either(a, b))


def _and(a: Array, b: Array) -> Array:
    return _told((a != 0) & (b != 0), _either(a, b) & (a != 0) & (b != 0))


def _or(a: Array, b: Array) -> Array:
    yes = ((a != 0) & ~np.isnan(a)) | ((b != 0) & ~np.isnan(b))
    return _told(yes, _either(a, b) & ~yes)


def _coalesce(*parts: Array) -> Array:
    out = parts[0]
    for p in parts[1:]:
        out = np.where(np.isnan(out), p, out)
    return out


def _pow(a: Array, b: Array) -> Array:
    sound = (a > 0) | ((a == 0) & (b > 0)) | ((a < 0) & (b == np.floor(b)))
    return np.where(sound, np.power(a, b), np.nan)


ROW = {
    "add": np.add, "sub": np.subtract, "mul": np.multiply, "neg": np.negative, "abs": np.abs, "sign": np.sign, "pow": _pow, "coalesce": _coalesce, "and": _and, "or": _or,
    "div": lambda a, b: np.where(b != 0, a / b, np.nan), "safediv": lambda a, b, p: np.where(np.abs(b) >= p[0], a / b, np.nan), "inv": lambda a, p: np.where(np.abs(a) >= p[0], 1 / a, np.nan),
    "square": lambda a: a * a, "cube": lambda a: a * a * a, "sqrt": lambda a: np.sqrt(np.where(a >= 0, a, np.nan)), "log": lambda a: np.log(np.where(a > 0, a, np.nan)),
    "log1p": lambda a: np.log1p(np.where(a > -1, a, np.nan)), "exp": lambda a: np.where(a < 700, np.exp(np.minimum(a, 700)), np.nan),
    "gt": _compare(np.greater), "lt": _compare(np.less), "ge": _compare(np.greater_equal), "le": _compare(np.less_equal), "eq": _compare(np.equal), "ne": _compare(np.not_equal),
    "where": lambda c, a, b: np.where((c != 0) & ~np.isnan(c), a, b), "max2": np.maximum, "min2": np.minimum,
    "clip": lambda a, p: np.clip(a, p[0], p[1]), "fill": lambda a, p: np.where(np.isnan(a), p[0], a), "notnull": lambda a: (~np.isnan(a)).astype(float),
}
WITH_PAR = {"safediv", "inv", "clip", "fill"}


class Block:
    """Some whole instruments as matrices; ``order`` holds the sessions' numbers."""

    def __init__(self, fields: dict[str, Array], order: Array) -> None:
        self.fields, self.order = fields, order
        self.known: dict[Node, Array] = {}
        self.parts: dict[tuple, Array] = {}

    def value(self, node: Node) -> Array:
        if node.op == "field" or node.key in self.fields:
            return self.fields[node.par[0] if node.op == "field" else node.key]
        if node not in self.known:
            if node.op in ("const", "null"):
                own = np.full(self.order.shape, node.par[0] if node.op == "const" else np.nan)
            else:
                args = [self.value(a) for a in node.args]
                if node.op in TIME:
                    own = self.over_time(node, args)
                else:
                    own = ROW[node.op](*args, node.par) if node.op in WITH_PAR else ROW[node.op](*args)
            self.known[node] = own
        return self.known[node]

    def _part(self, key: tuple, make: Callable[[], Array]) -> Array:
        if key not in self.parts:
            self.parts[key] = make()
        return self.parts[key]

    @staticmethod
    def frames(x: Array, n: int, empty: float) -> Array:
        """The n trailing values of each cell along a last axis; before the first one ``empty``, also in place of null."""
        x = np.where(np.isnan(x), empty, x) if empty == empty else x
        return sliding_window_view(np.concatenate([np.full((len(x), n - 1), empty), x], 1), n, 1)

    def held(self, name: str, x: Array, n: int) -> Array:
        def make() -> Array:
            total = np.cumsum(~np.isnan(x), 1)
            return (total - np.concatenate([np.zeros((len(x), min(n, x.shape[1])), int), total[:, :-n]], 1)).astype(float)

        return self._part(("held", name, n), make)

    def total(self, name: str, x: Array, n: int) -> Array:
        return self._part(("total", name, n), lambda: np.where(self.held(name, x, n) > 0, self.frames(x, n, 0.0).sum(-1), np.nan))

    def mean(self, name: str, x: Array, n: int) -> Array:
        return self._part(("mean", name, n), lambda: self.total(name, x, n) / self.held(name, x, n))

    def moment(self, name: str, x: Array, n: int, power: int) -> Array:
        """Mean of the powers of what lies off the frame's mean."""

        def make() -> Array:
            off = np.nan_to_num(self.frames(x, n, np.nan) - self.mean(name, x, n)[..., None])
            return (off**power).sum(-1) / self.held(name, x, n)

        return self._part(("moment", name, n, power), make)

    def spread(self, name: str, x: Array, n: int, sample: bool = False) -> Array:
        """Standard deviation; rounding noise beside the mean is zero."""
        m = self.held(name, x, n)
        var = self.moment(name, x, n, 2)
        sd = np.sqrt(var * m / np.where(m > 1, m - 1, np.nan) if sample else var)
        return np.where(sd <= np.abs(self.mean(name, x, n)) * TINY, 0.0, sd)

    def together(self, names: tuple[str, str], a: Array, b: Array, n: int) -> Array:
        """Population covariance of values that are both there."""

        def make() -> Array:
            u = self.frames(a, n, np.nan) - self.mean(names[0], a, n)[..., None]
            v = self.frames(b, n, np.nan) - self.mean(names[1], b, n)[..., None]
            return np.nan_to_num(u * v).sum(-1) / self.held(names[0], a, n)

        return self._part(("cov", names, n), make)

    def over_time(self, node: Node, args: list[Array]) -> Array:
        op, p, x, name = node.op, node.par, args[0], node.args[0].key
        t = x.shape[1]
        if op in ("lead", "wz"):
            x = np.where(np.isnan(self.order), np.nan, x)  # these look beyond an instrument's last row
        if op in ("lag", "lead"):
            out, k = np.full_like(x, np.nan), p[0]
            if k < t:
                if op == "lag":
                    out[:, k:] = x[:, : t - k]
                else:
                    out[:, : t - k] = x[:, k:]
            return out
        if op in ("ffill", "last_true"):
            there = ~np.isnan(x) & ((x != 0) if op == "last_true" else True)
            at = np.maximum.accumulate(np.where(there, np.arange(t), -1), 1)
            source = x if op == "ffill" else self.order
            found = np.where(at >= 0, np.take_along_axis(source, np.maximum(at, 0), 1), np.nan)
            return found if op == "ffill" else self.order - found
        if op == "cumsum":
            return np.where(np.cumsum(~np.isnan(x), 1) > 0, np.cumsum(np.nan_to_num(x), 1), np.nan)
        if op == "ema":
            return self.exponential(x, *p)
        if op == "wz":
            sd, centre = np.nanstd(x, 1, ddof=1, keepdims=True), np.nanmean(x, 1, keepdims=True)
            sd = np.where(sd <= np.abs(centre) * TINY, 0.0, sd)
            return np.where(sd > 0, (x - np.nanmedian(x, 1, keepdims=True)) / sd, np.nan)
        n, least = p[0], p[1]
        if op in ("corr", "cov"):
            gone, other = _either(x, args[1]), node.args[1].key
            u, v, names = np.where(gone, np.nan, x), np.where(gone, np.nan, args[1]), (f"{name}|{other}", f"{other}|{name}")
            held, both = self.held(names[0], u, n), self.together(names, u, v, n)
            value = both * held / np.where(held > 1, held - 1, np.nan) if op == "cov" else _ratio(both, self.spread(names[0], u, n), self.spread(names[1], v, n))
            return np.where(held >= least, value, np.nan)
        held = self.held(name, x, n)
        enough = held >= least
        if op == "count":
            return held
        if op in ("slope", "rsq"):
            when, names = np.where(np.isnan(x), np.nan, self.order), (name, f"t|{name}")
            both, wide = self.together(names, x, when, n), self.spread(names[1], when, n)
            if op == "slope":
                return np.where(enough & (held > 1), both / np.where(wide > 0, wide, np.nan) ** 2, np.nan)
            return np.where(enough, _ratio(both, self.spread(name, x, n), wide) ** 2, np.nan)
        if op in ("skew", "kurt"):
            var, wide = self.moment(name, x, n, 2), self.spread(name, x, n) > 0
            if op == "skew":
                value = self.moment(name, x, n, 3) / var**1.5 * np.sqrt(held * (held - 1)) / np.where(held > 2, held - 2, np.nan)
            else:
                value = ((held + 1) * (self.moment(name, x, n, 4) / var**2 - 3) + 6) * (held - 1) / np.where(held > 3, (held - 2) * (held - 3), np.nan)
            return np.where(enough & wide, value, np.nan)
        if op in ("std", "var"):
            sd = self.spread(name, x, n, bool(p[2]))
            return np.where(enough, sd if op == "std" else sd * sd, np.nan)
        if op == "tsrank":
            own = self.frames(x, n, np.nan)
            return np.where(enough & ~np.isnan(x), (own < x[..., None]).sum(-1) + ((own == x[..., None]).sum(-1) + 1) / 2, np.nan)
        if op in ("median", "quant"):
            own = self._part(("sorted", name, n), lambda: np.sort(self.frames(x, n, np.nan), -1))
            at = np.maximum(held, 1).astype(int)
            pick = lambda i: np.take_along_axis(own, i[..., None], -1)[..., 0]
            if op == "quant":
                place = (at - 1) * p[2]
                low = pick(np.floor(place).astype(int))
                return np.where(enough, low + (pick(np.ceil(place).astype(int)) - low) * (place - np.floor(place)), np.nan)
            return np.where(enough, pick((at - 1) // 2) / 2 + pick(at // 2) / 2, np.nan)
        if op == "decay":
            own = self.frames(x, n, np.nan)
            place = np.cumsum(~np.isnan(own), -1)
            return np.where(enough & (held > 0), np.nan_to_num(own * place).sum(-1) / np.where(held > 0, held * (held + 1) / 2, np.nan), np.nan)
        if op in ("min", "max"):
            none = np.inf if op == "min" else -np.inf
            own = self.frames(x, n, none)
            return np.where(enough & (held > 0), own.min(-1) if op == "min" else own.max(-1), np.nan)
        return np.where(enough, self.mean(name, x, n) if op == "mean" else self.total(name, x, n), np.nan)

    @staticmethod
    def exponential(x: Array, alpha: float, adjust: bool, least: int) -> Array:
        """Exponential mean as its recursion; null adds nothing while weights go on fading."""
        there, value = ~np.isnan(x), np.nan_to_num(x)
        out, keep = np.full_like(x, np.nan), 1 - alpha
        top, weight, begun = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), bool)
        for t in range(x.shape[1]):
            now = there[:, t]
            if adjust:
                top, weight = top * keep + value[:, t], weight * keep + now
            else:
                top = np.where(now & ~begun, value[:, t], top * keep + alpha * value[:, t])
            begun |= now
            out[:, t] = top / np.where(begun, weight, np.nan) if adjust else np.where(begun, top, np.nan)
        return np.where(np.cumsum(there, 1) >= least, out, np.nan)


def _ratio(covariance: Array, sx: Array, sy: Array) -> Array:
    return np.where((sx > 0) & (sy > 0), covariance / np.where((sx > 0) & (sy > 0), sx * sy, np.nan), np.nan)


def outermost(signals: list[Node], known: set[Node]) -> list[Node]:
    """The largest expressions that hold a time operator and no cross operator but known ones."""

    def crossing(n: Node) -> bool:
        return n not in known and (n.op in CROSS or any(crossing(a) for a in n.args))

    def timed(n: Node) -> bool:
        return n not in known and (n.op in TIME or any(timed(a) for a in n.args))

    found: dict[Node, None] = {}

    def walk(n: Node) -> None:
        if n in known:
            return
        if not crossing(n):
            if timed(n):
                found[n] = None
            return
        for a in n.args:
            walk(a)

    for s in signals:
        walk(s)
    return list(found)


def with_time(panel: DataFrame, nodes: list[Node], known: set[Node], instrument: str, order: str, placed: bool = False, keep: list[str] | None = None, beside: list[str] = ()) -> DataFrame:
    """``panel`` with a column for each of ``nodes`` (see :func:`outermost`): one shuffle by instrument, one sort, one pass. None
    of the shuffle where ``panel`` is ``placed`` by instrument already. Of the panel's columns ``keep`` comes out, or all.
    With ``beside`` a row of which BACK is true brings these columns to the panel's row of its instrument and session."""
    fields = {a.par[0] if a.op == "field" else a.key for n in nodes for a in _leaves(n, known)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            kept = part if kept is None else pa.concat_tables([kept, part])
            if kept.num_rows >= BLOCK:
                heads = _heads(kept, instrument)
                if len(heads) > 1:  # the last instrument may go on
                    yield from made(kept.slice(0, int(heads[-1])), heads[:-1])
                    kept = kept.slice(int(heads[-1]))
        if kept is not None and kept.num_rows:
            yield from made(kept, _heads(kept, instrument))

    def made(rows: pa.Table, heads: Array) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        if beside:
            back = rows.column(BACK).to_numpy()
            brought, follows = rows.filter(pa.array(back)), np.append(back[1:], False)[~back]
            rows = rows.filter(pa.array(~back))
            at = pa.array(np.cumsum(follows) - 1, mask=~follows)  # each follows the panel's row
            for c in beside:
                rows = rows.set_column(rows.column_names.index(c), c, brought.column(c).take(at))
            heads = _heads(rows, instrument)
        size = np.diff(np.append(heads, rows.num_rows))
        i = np.repeat(np.arange(len(heads)), size)
        j = np.arange(rows.num_rows) - heads[i]

        def matrix(c: str) -> Array:
            out = np.full((len(heads), int(size.max())), np.nan)
            out[i, j] = rows.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            return out

        with np.errstate(all="ignore"):
            block = Block({c: matrix(c) for c in fields}, matrix(order))
            values = [np.broadcast_to(block.value(n), block.order.shape)[i, j] for n in nodes]
        columns = [*(rows.column(c) for c in kept_columns), *(pa.array(v, pa.float64(), from_pandas=True) for v in values)]
        yield from pa.table(columns, names=[*kept_columns, *(n.key for n in nodes)]).to_batches(max_chunksize=BLOCK)

    kept_columns = panel.columns if keep is None else keep
    schema = T.StructType([*(panel.schema[c] for c in kept_columns), *(T.StructField(n.key, T.DoubleType()) for n in nodes)])
    # numbered, because the little that is shuffled here is much work: it isn't to be coalesced into few tasks
    within = [BACK] if beside else []
    if placed:
        # a window asks for whole instruments, so that Spark itself moves the rows if they should not lie so
        whole = panel.withColumn("_row", F.row_number().over(Window.partitionBy(instrument).orderBy(order, *within)))
    else:
        whole = by_key(panel, instrument)
    return whole.sortWithinPartitions(instrument, order, *within).mapInArrow(run, schema)


def by_key(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _leaves(n: Node, known: set[Node]) -> Iterator[Node]:
    if n.op == "field" or n in known:
        yield n
    else:
        for a in n.args:
            yield from _leaves(a, known)


def _heads(rows: pa.Table, instrument: str) -> Array:
    code = rows.column(instrument).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    return np.nonzero(np.concatenate([[True], np.diff(code) != 0]))[0]


class Sessions:
    """Some whole sessions as flat arrays; rows of a session lie together, in the order of their instruments."""

    def __init__(self, session: Array, group: Array | None) -> None:
        self.session = session
        self.group = None if group is None else np.unique(session * (int(group.max(initial=0)) + 2) + group + 1, return_inverse=True)[1]

    @staticmethod
    def _held(x: Array, of: Array) -> Array:
        return np.bincount(of, ~np.isnan(x))

    def _total(self, x: Array, of: Array) -> Array:
        return np.where(self._held(x, of) > 0, np.bincount(of, np.nan_to_num(x, posinf=np.inf, neginf=-np.inf)), np.nan)

    def _mean(self, x: Array, of: Array) -> Array:
        return self._total(x, of) / self._held(x, of)

    @staticmethod
    def _sorted(x: Array, of: Array) -> tuple[Array, Array, Array]:
        """Rows with a value in order of their part and value, those parts, and where each part begins."""
        there = np.nonzero(~np.isnan(x))[0]
        order = there[np.lexsort((x[there], of[there]))]
        parts = of[order]
        return order, parts, np.searchsorted(parts, np.arange(int(of.max(initial=-1)) + 1))

    def _rank(self, x: Array, of: Array, first: bool) -> Array:
        order, parts, heads = self._sorted(x, of)
        place, out = np.arange(len(order)) - heads[parts] + 1.0, np.full(len(x), np.nan)
        if not first and len(order):
            new = np.concatenate([[True], (np.diff(parts) != 0) | (np.diff(x[order]) != 0)])
            run = np.cumsum(new) - 1
            place = (np.bincount(run, place) / np.bincount(run))[run]
        out[order] = place
        return out

    def _extreme(self, x: Array, of: Array, least: bool) -> Array:
        order, _, heads = self._sorted(x, of)
        held = self._held(x, of).astype(int)
        at = heads if least else heads + held - 1
        out = np.full(len(held), np.nan)
        out[held > 0] = x[order[at[held > 0]]]
        return out

    def _median(self, x: Array, of: Array) -> Array:
        order, _, heads = self._sorted(x, of)
        held = self._held(x, of).astype(int)
        out, some = np.full(len(held), np.nan), held > 0
        low, high = heads[some] + (held[some] - 1) // 2, heads[some] + held[some] // 2
        out[some] = x[order[low]] + (x[order[high]] - x[order[low]]) * 0.5
        return out

    def scale(self, node: Node, x: Array) -> tuple[Array, Array]:
        """What an ``xz`` takes off and divides by in each session; NaN where it has no value."""
        how, ddof, least = node.par
        of = self.session
        mean, held = self._mean(x, of), self._held(x, of)
        off = np.nan_to_num(x - mean[of]) ** 2
        sd = np.sqrt(np.bincount(of, off) / np.where(held > ddof, held - bool(ddof), np.nan))
        sd = np.where(sd <= np.abs(mean) * TINY, 0.0, sd)
        sound = (held >= least) & (sd > 0)
        return np.where(sound, self._median(x, of) if how == "median" else mean, np.nan), np.where(sound, sd, np.nan)

    def numbers(self, node: Node, x: Array) -> tuple[Array, ...]:
        """The numbers of each session from which ``node``, one of SESSION, follows row by row."""
        if node.op == "xz":
            return self.scale(node, x)
        if node.op == "xscale":
            return self._extreme(x, self.session, True), self._extreme(x, self.session, False)
        return (self.value(node, x)[np.unique(self.session, return_index=True)[1]],)

    def value(self, node: Node, x: Array) -> Array:
        op, p, of = node.op, node.par, self.group if node.op.startswith("g") else self.session
        n = self._held(x, of)[of]
        if op.startswith("xrank"):
            place = self._rank(x, of, op == "xrank_first")
            return {"xrank_no": place, "xrank_mid": np.where(n >= 2, (place - 0.5) / n, np.nan)}.get(op, place / n)
        if op == "xz":
            centre, sd = self.scale(node, x)
            return (x - centre[of]) / sd[of]
        if op == "xscale":
            lo, hi = self._extreme(x, of, True)[of], self._extreme(x, of, False)[of]
            return np.where(np.isnan(x), np.nan, np.where(hi > lo, (x - lo) / np.where(hi > lo, hi - lo, np.nan), 0.0))
        if op[1:] in ("min", "max"):
            return self._extreme(x, of, op[1:] == "min")[of]
        return n if op[1:] == "count" else (self._mean if op[1:] == "mean" else self._total)(x, of)[of]


def _whole_sessions(session: str, group: str | None, fields: set[str], made: Callable[[pa.Table, Array, Block, Sessions], pa.Table]) -> Callable:
    """What takes sorted rows as whole sessions: ``made`` gets some, where each begins, and them as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            kept = part if kept is None else pa.concat_tables([kept, part])
            if kept.num_rows >= BLOCK:
                heads = _heads(kept, session)
                if len(heads) > 1:
                    yield from block(kept.slice(0, int(heads[-1])), heads[:-1])
                    kept = kept.slice(int(heads[-1]))
        if kept is not None and kept.num_rows:
            yield from block(kept, _heads(kept, session))

    def block(rows: pa.Table, heads: Array) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        own = np.zeros(rows.num_rows, np.int64)
        own[heads[1:]] = 1
        code = rows.column(group).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) if group else None
        flat = {c: rows.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in fields}
        with np.errstate(all="ignore"):
            out = made(rows, heads, Block(flat, np.zeros(rows.num_rows)), Sessions(np.cumsum(own), code))
        yield from out.to_batches(max_chunksize=BLOCK)

    return run


def _doubles(values: list[Array]) -> list[pa.Array]:
    return [pa.array(v, pa.float64(), from_pandas=True) for v in values]


def with_cross(panel: DataFrame, nodes: list[Node], known: set[Node], instrument: str, session: str, group: str | None) -> DataFrame:
    """``panel`` with a column for each cross node of ``nodes``: one shuffle by session, one sort, one pass over whole sessions."""
    fields = {a.par[0] if a.op == "field" else a.key for n in nodes for x in n.args for a in _leaves(x, known)}

    def made(rows: pa.Table, heads: Array, block: Block, cut: Sessions) -> pa.Table:
        values = [cut.value(n, block.value(n.args[0])) for n in nodes]
        return pa.table([*rows.columns, *_doubles(values)], names=[*rows.column_names, *(n.key for n in nodes)])

    schema = T.StructType([*panel.schema.fields, *(T.StructField(n.key, T.DoubleType()) for n in nodes)])
    run = _whole_sessions(session, group if any(n.op.startswith("g") for n in nodes) else None, fields, made)
    return by_key(panel, session).sortWithinPartitions(session, instrument).mapInArrow(run, schema)


#: Cross operators whose value in a row follows from the row and one or two numbers of its session.
SESSION = {"xz": 2, "xscale": 2, "xmean": 1, "xsum": 1, "xmin": 1, "xmax": 1, "xcount": 1}


def crossings(roots: list[Node], known: set[Node]) -> list[Node]:
    """The cross operators of ``roots`` that aren't known, each after those it needs."""
    return list(dict.fromkeys(n for root in roots for n in root.walk() if n.op in CROSS and n not in known))


def whole_inputs(roots: list[Node], known: set[Node]) -> list[Node]:
    """The largest expressions without an unknown cross operator from which those of ``roots`` and then ``roots`` follow."""
    found: dict[Node, None] = {}

    def walk(n: Node) -> None:
        if n.op in ("const", "null"):
            return
        if n.op == "neg" or (n not in known and (n.op in CROSS or crossings([n], known))):
            for a in n.args:
                walk(a)
        else:
            found[n] = None

    for r in roots:
        walk(r)
    return list(found)


def session_numbers(inputs: DataFrame, nodes: list[Node], known: set[Node], session: str) -> DataFrame:
    """One row a session: for each of ``nodes`` (SESSION) its numbers as columns ``key_0``, ``key_1``. ``inputs`` are sorted by session."""
    fields = {a.par[0] if a.op == "field" else a.key for n in nodes for x in n.args for a in _leaves(x, known | set(nodes)) if a not in nodes}
    names = [f"{n.key}_{i}" for n in nodes for i in range(SESSION[n.op])]

    def made(rows: pa.Table, heads: Array, block: Block, cut: Sessions) -> pa.Table:
        out: list[Array] = []
        for n in nodes:
            x = np.broadcast_to(block.value(n.args[0]), cut.session.shape)
            out += cut.numbers(n, x)
            block.known[n] = cut.value(n, x)
        return pa.table([rows.column(session).take(pa.array(heads)), *_doubles(out)], names=[session, *names])

    schema = T.StructType([inputs.schema[session], *(T.StructField(c, T.DoubleType()) for c in names)])
    return inputs.mapInArrow(_whole_sessions(session, None, fields, made), schema)


def from_numbers(node: Node, x: Column) -> Column:
    """The row's value of ``node`` from its argument and :func:`session_numbers`."""
    a, b = F.col(f"{node.key}_0"), F.col(f"{node.key}_1")
    if node.op == "xz":
        return (x - a) / b
    if node.op == "xscale":
        return F.when(x.isNotNull(), F.when(b > a, (x - a) / (b - a)).otherwise(0.0))
    return a


def row_values(inputs: DataFrame, roots: list[Node], known: set[Node], instrument: str, order: str, session: str, group: str | None) -> DataFrame:
    """(``instrument``, ``order``, a column for each of ``roots``), without rows that have none of them. ``inputs`` are sorted by session."""
    nodes = crossings(roots, known)
    fields = {a.par[0] if a.op == "field" else a.key for r in roots for a in _leaves(r, known)}

    def made(rows: pa.Table, heads: Array, block: Block, cut: Sessions) -> pa.Table:
        for n in nodes:
            block.known[n] = cut.value(n, np.broadcast_to(block.value(n.args[0]), cut.session.shape))
        values = [np.broadcast_to(block.value(r), cut.session.shape) for r in roots]
        some = pa.array(~np.all([np.isnan(v) for v in values], 0))
        return pa.table([rows.column(instrument), rows.column(order), *_doubles(values)], names=[instrument, order, *(r.key for r in roots)]).filter(some)

    schema = T.StructType([inputs.schema[instrument], inputs.schema[order], *(T.StructField(r.key, T.DoubleType()) for r in roots)])
    return inputs.mapInArrow(_whole_sessions(session, group if any(n.op.startswith("g") for n in nodes) else None, fields, made), schema)
