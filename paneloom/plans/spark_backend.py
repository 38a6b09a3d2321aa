"""Nodes to Spark columns, in as few shuffles as the alternation of time and cross operators allows.

All time operators that are ready are computed over one partitioning (instrument), then all cross operators over another
(session), and so on; row operators are inlined. Equal window specifications share one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nodes import Node

TINY = 1e-12


def _bool(c: Column) -> Column:
    return c.cast("double")


def _both(a: Column, b: Column, c: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), c)


ROW = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.when(b != 0, a / b),
    "safediv": lambda a, b, p: F.when(F.abs(b) >= p[0], a / b),
    "neg": lambda a: -a,
    "abs": F.abs,
    "square": lambda a: a * a,
    "cube": lambda a: a * a * a,
    "inv": lambda a, p: F.when(F.abs(a) >= p[0], 1 / a),
    "sign": lambda a: F.when(a > 0, 1.0).when(a < 0, -1.0).when(a == 0, 0.0),
    "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)),
    "log": lambda a: F.when(a > 0, F.ln(a)),
    "log1p": lambda a: F.when(a > -1, F.log1p(a)),
    "exp": lambda a: F.when(a < 700, F.exp(a)),
    "pow": lambda a, b: F.when((a > 0) | ((a == 0) & (b > 0)) | ((a < 0) & (b == F.floor(b))), F.pow(a, b)),
    "gt": lambda a, b: _bool(a > b),
    "lt": lambda a, b: _bool(a < b),
    "ge": lambda a, b: _bool(a >= b),
    "le": lambda a, b: _bool(a <= b),
    "eq": lambda a, b: _bool(a == b),
    "ne": lambda a, b: _bool(a != b),
    "and": lambda a, b: _bool((a != 0) & (b != 0)),
    "or": lambda a, b: _bool((a != 0) | (b != 0)),
    "where": lambda c, a, b: F.when(c != 0, a).otherwise(b),
    "max2": lambda a, b: _both(a, b, F.greatest(a, b)),
    "min2": lambda a, b: _both(a, b, F.least(a, b)),
    "clip": lambda a, p: F.when(a.isNotNull(), F.greatest(F.lit(p[0]), F.least(F.lit(p[1]), a))),
    "fill": lambda a, p: F.coalesce(a, F.lit(p[0])),
    "coalesce": F.coalesce,
    "notnull": lambda a: _bool(a.isNotNull()),
}
WITH_PAR = {"safediv", "inv", "clip", "fill"}


def _snap(sd: Column, centre: Column) -> Column:
    """A deviation that is rounding noise beside its centre is zero."""
    return F.when(sd <= F.abs(centre) * TINY, 0.0).otherwise(sd)


class Keys:
    def __init__(self, instrument: str, order: str, session: str, group: str | None) -> None:
        self.instrument, self.order, self.session, self.group = instrument, order, session, group

    def trailing(self, n: int) -> Window:
        return Window.partitionBy(self.instrument).orderBy(self.order).rowsBetween(-(n - 1), 0)

    def so_far(self) -> Window:
        return Window.partitionBy(self.instrument).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)

    def along(self) -> Window:
        return Window.partitionBy(self.instrument).orderBy(self.order)


class Frames:
    """Window aggregates that the operators of a step ask for, each computed once: a mean, a deviation and their guards over the same
    frame share their parts. Asking gives the name of a column; ``columns`` makes them all."""

    AGGREGATES = {"count": F.count, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "sd": F.stddev_samp, "sdp": F.stddev_pop, "skew": F.skewness, "kurt": F.kurtosis, "list": F.collect_list}

    def __init__(self, keys: Keys) -> None:
        self.keys = keys
        self.asked: dict[tuple, tuple[str, Column]] = {}

    def _ask(self, key: tuple, make) -> Column:
        if key not in self.asked:
            self.asked[key] = (f"_f{len(self.asked)}", make())
        return F.col(self.asked[key][0])

    def over(self, how: str, name: str, x: Column, n: int | None) -> Column:
        """Aggregate ``how`` of x (known as ``name``) over n trailing sessions, or over all so far."""
        w = lambda: self.keys.so_far() if n is None else self.keys.trailing(n)
        return self._ask((how, name, n), lambda: self.AGGREGATES[how](x).over(w()))

    def pair(self, how: str, names: tuple[str, str], a: Column, b: Column, n: int) -> Column:
        make = {"cov": F.covar_samp, "covp": F.covar_pop, "slope": F.regr_slope}[how]
        return self._ask((how, *names, n), lambda: make(a, b).over(self.keys.trailing(n)))

    def columns(self) -> dict[str, Column]:
        return dict(self.asked.values())


def _time(node: Node, a: list[Column], k: Keys, f: Frames) -> Column:
    op, p = node.op, node.par
    x, name = a[0], node.args[0].key
    if op == "lag":
        return F.lag(x, p[0]).over(k.along())
    if op == "lead":
        return F.lead(x, p[0]).over(k.along())
    if op in ("ffill", "cumsum", "last_true"):
        w = k.so_far()
        if op == "ffill":
            return F.last(x, ignorenulls=True).over(w)
        if op == "cumsum":
            return F.sum(x).over(w)
        return F.col(k.order) - F.last(F.when(x != 0, F.col(k.order)), ignorenulls=True).over(w)
    if op == "ema":
        return _ema(node, x, k, f)
    if op == "wz":  # over the whole series, later sessions included
        w = Window.partitionBy(k.instrument)
        sd = _snap(F.stddev_samp(x).over(w), F.avg(x).over(w))
        return F.when(sd > 0, (x - F.percentile(x, F.lit(0.5)).over(w)) / sd)
    n, least = p[0], p[1]
    get = lambda how: f.over(how, name, x, n)
    spread = lambda nm, c: _snap(f.over("sdp", nm, c, n), f.over("avg", nm, c, n))
    if op in ("corr", "cov"):
        y = a[1]
        both = x.isNotNull() & y.isNotNull()
        names = (f"{name}|{node.args[1].key}", f"{node.args[1].key}|{name}")
        u, v = F.when(both, x), F.when(both, y)
        enough = f.over("count", names[0], u, n) >= least
        if op == "cov":
            return F.when(enough, f.pair("cov", names, u, v, n))
        return F.when(enough, _ratio(f.pair("covp", names, u, v, n), spread(names[0], u), spread(names[1], v)))
    held = get("count")
    enough = held >= least
    if op == "count":
        return held.cast("double")
    if op in ("slope", "rsq"):
        t = F.when(x.isNotNull(), F.col(k.order).cast("double"))
        if op == "slope":
            return F.when(enough & (held > 1), f.pair("slope", (name, f"t|{name}"), x, t, n))
        return F.when(enough, F.pow(_ratio(f.pair("covp", (name, f"t|{name}"), x, t, n), spread(name, x), spread(f"t|{name}", t)), 2))
    if op in ("skew", "kurt"):
        m = held.cast("double")
        if op == "skew":
            value = get("skew") * F.sqrt(m * (m - 1)) / F.when(m > 2, m - 2)
        else:
            value = ((m + 1) * get("kurt") + 6) * (m - 1) / F.when(m > 3, (m - 2) * (m - 3))
        return F.when(enough & (spread(name, x) > 0), value)
    if op in ("std", "var"):
        sd = _snap(get("sd" if p[2] else "sdp"), get("avg"))
        return F.when(enough, sd if op == "std" else sd * sd)
    if op in ("tsrank", "decay", "median", "quant"):
        own = get("list")
        if op == "quant":
            place = (F.size(own) - 1) * p[2]
            low = F.sort_array(own)[F.floor(place).cast("int")]
            return F.when(enough, low + (F.sort_array(own)[F.ceil(place).cast("int")] - low) * (place - F.floor(place)))
        if op == "tsrank":
            below, equal = (F.size(F.filter(own, lambda e: e < x)), F.size(F.filter(own, lambda e: e == x)))
            return F.when(enough & x.isNotNull(), (below + (equal + 1) / 2))
        if op == "median":
            return F.when(enough, F.sort_array(own)[F.floor((F.size(own) - 1) / 2).cast("int")] / 2 + F.sort_array(own)[F.floor(F.size(own) / 2).cast("int")] / 2)
        weighted = F.aggregate(F.transform(own, lambda e, i: e * (i + 1)), F.lit(0.0), lambda s, e: s + e)
        return F.when(enough, weighted / (F.size(own) * (F.size(own) + 1) / 2))
    return F.when(enough, get({"mean": "avg"}.get(op, op)))


def _ratio(covariance: Column, sx: Column, sy: Column) -> Column:
    """Correlation from its parts; null where either side is constant (the built-in one divides by zero there)."""
    return F.when((sx > 0) & (sy > 0), covariance / (sx * sy))


#: What lies beyond an exponential mean's frame weighs less than exp(-BEYOND) of it.
BEYOND = 27.7


def ema_frame(alpha: float) -> int:
    return max(2, math.ceil(BEYOND / -math.log(1 - alpha)))


def _ema(node: Node, x: Column, k: Keys, f: Frames) -> Column:
    """First-order recursion as sums over a frame: weights grow within blocks as long as the frame, of which a frame
    touches two, so that nothing overflows."""
    alpha, adjust, least = node.par
    b, name = 1 - alpha, node.args[0].key
    size = ema_frame(alpha)
    pos = F.col(k.order)
    inside, parity = pos % size, F.floor(pos / size) % 2
    grow = F.pow(F.lit(1 / b), inside)

    def weighed(value: Column, what: str) -> Column:
        half = lambda side: F.coalesce(f.over("sum", f"{what}|{name}|{alpha}|{side}", F.when(parity == side, value * grow), size), F.lit(0.0))
        even, odd = half(0), half(1)
        own, other = F.when(parity == 0, even).otherwise(odd), F.when(parity == 0, odd).otherwise(even)
        return own * F.pow(F.lit(b), inside) + other * F.pow(F.lit(b), inside + size)

    enough = f.over("count", name, x, None) >= least
    if adjust:
        return F.when(enough, weighed(x, "x") / weighed(F.when(x.isNotNull(), 1.0), "1"))
    # the first value starts the recursion with its whole weight: where it lies in the frame, the rest of it is added
    first = f.over("min", f"at|{name}", F.when(x.isNotNull(), pos), None)
    value = f._ask(("first", name), lambda: F.first(x, ignorenulls=True).over(k.so_far()))
    age = pos - first
    return F.when(enough, weighed(x, "x") * alpha + F.when(age < size, F.pow(F.lit(b), age + 1) * value).otherwise(0.0))


def _cross(node: Node, a: list[Column], k: Keys) -> Column:
    op, p = node.op, node.par
    x = a[0]
    on = [k.session] + ([k.group] if op.startswith("g") else [])
    w = Window.partitionBy(*on)
    n = F.count(x).over(w)
    if op in ("xrank", "xrank_mid", "xrank_first", "xrank_no"):
        held = Window.partitionBy(*on, x.isNull())
        if op == "xrank_first":
            return F.when(x.isNotNull(), F.row_number().over(held.orderBy(x, k.instrument)) / n)
        place = F.rank().over(held.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*on, x)) - 1) / 2
        if op == "xrank_no":
            return F.when(x.isNotNull(), place)
        return F.when(x.isNotNull(), place / n) if op == "xrank" else F.when(x.isNotNull() & (n >= 2), (place - 0.5) / n)
    if op == "xz":
        how, ddof, least = p
        centre = F.percentile(x, F.lit(0.5)).over(w) if how == "median" else F.avg(x).over(w)
        sd = _snap((F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(w), F.avg(x).over(w))
        return F.when((n >= least) & (sd > 0), (x - centre) / sd)
    if op == "xscale":
        lo, hi = F.min(x).over(w), F.max(x).over(w)
        return F.when(x.isNotNull(), F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0))
    agg = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[op[1:]]
    return agg(x).over(w).cast("double")


TIME = {"lag", "lead", "ffill", "cumsum", "last_true", "ema", "mean", "sum", "min", "max", "std", "var", "count", "skew", "kurt", "slope", "rsq", "tsrank", "decay", "median", "quant", "corr", "cov", "wz"}
CROSS = {"xrank", "xrank_mid", "xrank_first", "xrank_no", "xz", "xscale", "xmean", "xsum", "xmin", "xmax", "xcount", "gmean", "gsum", "gcount"}


def kind(node: Node) -> str:
    return "time" if node.op in TIME else "cross" if node.op in CROSS else "row"


def schedule(nodes: list[Node]) -> list[tuple[str, list[Node]]]:
    """Steps (kind, window nodes), each node after those it needs; a kind goes on as long as it has nodes that are ready."""
    wanted = {n: None for root in nodes for n in root.walk() if kind(n) != "row"}
    needs = {n: {m for a in n.args for m in a.walk() if m in wanted} for n in wanted}
    done: set[Node] = set()
    steps: list[tuple[str, list[Node]]] = []
    now = "time"
    while len(done) < len(wanted):
        while ready := [n for n in wanted if n not in done and kind(n) == now and needs[n] <= done]:
            steps.append((now, ready))
            done.update(ready)
        now = "cross" if now == "time" else "time"
    return steps


def column(node: Node, known: set[Node]) -> Column:
    if node in known:
        return F.col(node.key)
    if node.op == "field":
        return F.col(node.par[0])
    if node.op == "const":
        return F.lit(node.par[0])
    if node.op == "null":
        return F.lit(None).cast("double")
    args = [column(a, known) for a in node.args]
    return ROW[node.op](*args, node.par) if node.op in WITH_PAR else ROW[node.op](*args)


#: From more time operators than this on, windows are taken from matrices of instruments (``matrix_backend``) and not as columns.
MANY = 40


def _by_matrices(panel: DataFrame, roots: list[Node], known: set[Node], k: Keys) -> DataFrame:
    """``panel`` with the columns from which :func:`column` makes ``roots``, which ``known`` then has."""
    from .matrix_backend import outermost, with_cross, with_time

    def ready(n: Node) -> bool:
        return n in known or (kind(n) == "row" and all(map(ready, n.args)))

    crossing = {n: None for root in roots for n in root.walk() if kind(n) == "cross"}
    while True:
        if nodes := outermost(roots, known):
            panel = with_time(panel, nodes, known, k.instrument, k.order)
            known |= set(nodes)
        now = [n for n in crossing if n not in known and all(map(ready, n.args))]
        if not now:
            return panel
        panel = with_cross(panel, now, known, k.instrument, k.session, k.group)
        known |= set(now)


#: Cross operators that a session's aggregate gives, so that a time operator over them needs no row of another instrument.
SERIES = {"xmean": F.avg, "xsum": F.sum, "xmin": F.min, "xmax": F.max, "xcount": F.count}


def _below(roots: list[Node]) -> dict[Node, None]:
    """The cross operators that lie under a time operator."""
    return {n: None for root in roots for t in root.walk() if kind(t) == "time" for a in t.args for n in a.walk() if kind(n) == "cross"}


def _by_inputs(panel: DataFrame, roots: list[Node], known: set[Node], k: Keys, placed: bool) -> DataFrame:
    """The same where time operators lie over no cross operators but SERIES. Wide rows stay where their instrument is: to the
    sessions go only the inputs of cross operators, back come a few numbers a session, and values row by row of signals with
    ranks and groups alone. Time operators that are inputs are computed twice; that costs less than moving what they give."""
    from .matrix_backend import BACK, SESSION, by_key, crossings, from_numbers, outermost, row_values, session_numbers, whole_inputs, with_time

    columns, panel = panel.columns, panel if placed else by_key(panel, k.instrument)
    if below := _below(roots):
        args = list(dict.fromkeys(n.args[0] for n in below))
        rows = with_time(panel, args, known, k.instrument, k.order, True, [k.session])
        series = rows.groupBy(k.session).agg(*(SERIES[n.op](n.args[0].key).cast("double").alias(n.key) for n in below))
        panel = panel.join(F.broadcast(series), k.session, "left")  # one row a session
        known |= set(below)
    crossed = [r for r in roots if crossings([r], known)]
    byrow = [r for r in crossed if any(n.op not in SESSION for n in crossings([r], known))]
    byday = crossings([r for r in crossed if r not in byrow], known)
    if crossed:
        asked = whole_inputs([*byrow, *byday], known)
        nodes, fields = [n for n in asked if n.op != "field" and n not in known], [n.par[0] if n.op == "field" else n.key for n in asked if n.op == "field" or n in known]
        group = [k.group] if any(n.op.startswith("g") for n in crossings(byrow, known)) else []
        narrow = with_time(panel, nodes, known, k.instrument, k.order, True, list(dict.fromkeys([k.instrument, k.order, k.session, *group, *fields])))
        narrow = by_key(narrow, k.session).sortWithinPartitions(k.session, k.instrument)
    if byrow:
        back = row_values(narrow, byrow, known | set(nodes), k.instrument, k.order, k.session, k.group)
        # a join by instrument and session would shuffle both sides by both; a union stays where both lie by instrument
        panel = panel.withColumn(BACK, F.lit(False)).unionByName(by_key(back, k.instrument).withColumn(BACK, F.lit(True)), allowMissingColumns=True)
        known |= set(byrow)
    if (last := outermost(roots, known)) or byrow:
        panel = with_time(panel, last, known, k.instrument, k.order, True, list(dict.fromkeys([*columns, *(n.key for n in known)])), [r.key for r in byrow])
    if byday:
        panel = panel.join(F.broadcast(session_numbers(narrow, byday, known | set(nodes), k.session)), k.session, "left")  # one row a session
    known |= set(last)
    for n in byday:
        panel = panel.withColumn(n.key, from_numbers(n, column(n.args[0], known)))
        known.add(n)
    return panel.select(*columns, *(n.key for n in known))


def evaluate(panel: DataFrame, signals: dict[str, Node], instrument: str = "ts_code", order: str = "idx", session: str = "trade_date", group: str | None = "industry", placed: bool = False) -> DataFrame:
    """``panel`` with one column for each signal. ``panel`` has one row for an instrument and session; ``order`` is the
    session's number, without holes within an instrument (see ``dense_panel``). Nulls stay null, results are never NaN
    or infinite: what would be is null. ``placed``: each instrument lies in one of spark.sql.shuffle.partitions parts already."""
    k = Keys(instrument, order, session, group)
    known: set[Node] = set()
    roots = list(signals.values())
    if len({n for root in roots for n in root.walk() if kind(n) == "time"}) > MANY:
        # a time operator over other cross operators needs whole rows to go to and fro
        if any(n.op not in SERIES or any(kind(a) == "cross" for a in n.args[0].walk()) for n in _below(roots)):
            return _finished(_by_matrices(panel, roots, known, k), signals, known)
        return _finished(_by_inputs(panel, roots, known, k, placed), signals, known)
    for what, nodes in schedule(list(signals.values())):
        frames = Frames(k)
        make = (lambda n, a, keys: _time(n, a, keys, frames)) if what == "time" else _cross
        # inputs first: an expression under several windows is then computed once
        inputs = {a: None for n in nodes for a in n.args if a not in known and a.op not in ("field", "const")}
        panel = panel.withColumns({a.key: column(a, known) for a in inputs})
        known |= set(inputs)
        made = {n.key: make(n, [column(a, known) for a in n.args], k) for n in nodes}
        shared = frames.columns()
        panel = panel.withColumns(shared).withColumns(made).drop(*shared)
        known |= set(nodes)
    return _finished(panel, signals, known)


def _finished(panel: DataFrame, signals: dict[str, Node], known: set[Node]) -> DataFrame:
    out = {name: column(node, known) for name, node in signals.items()}
    finite = {name: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) for name, c in out.items()}
    return panel.withColumns(finite).drop(*(n.key for n in known))
