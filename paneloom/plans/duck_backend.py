"""Nodes to DuckDB SQL: a second, separately written back end that the tests hold the first one against."""

from __future__ import annotations

from .nodes import Node
from .spark_backend import TINY, ema_frame, schedule


def _num(x: float) -> str:
    return f"cast({x!r} as double)"


ROW = {
    "add": "({0} + {1})", "sub": "({0} - {1})", "mul": "({0} * {1})", "neg": "(-{0})", "abs": "abs({0})", "square": "({0} * {0})", "cube": "({0} * {0} * {0})",
    "div": "(case when {1} <> 0 then {0} / {1} end)", "sqrt": "(case when {0} >= 0 then sqrt({0}) end)", "log": "(case when {0} > 0 then ln({0}) end)",
    "log1p": "(case when {0} > -1 then ln(1 + {0}) end)", "exp": "(case when {0} < 700 then exp({0}) end)", "sign": "cast(sign({0}) as double)",
    "pow": "(case when {0} > 0 or ({0} = 0 and {1} > 0) or ({0} < 0 and {1} = floor({1})) then pow({0}, {1}) end)",
    "gt": "cast(cast({0} > {1} as int) as double)", "lt": "cast(cast({0} < {1} as int) as double)", "ge": "cast(cast({0} >= {1} as int) as double)",
    "le": "cast(cast({0} <= {1} as int) as double)", "eq": "cast(cast({0} = {1} as int) as double)", "ne": "cast(cast({0} <> {1} as int) as double)",
    "and": "cast(cast(({0} <> 0) and ({1} <> 0) as int) as double)", "or": "cast(cast(({0} <> 0) or ({1} <> 0) as int) as double)",
    "where": "(case when {0} <> 0 then {1} else {2} end)", "max2": "(case when {0} is not null and {1} is not null then greatest({0}, {1}) end)",
    "min2": "(case when {0} is not null and {1} is not null then least({0}, {1}) end)", "notnull": "cast(cast({0} is not null as int) as double)",
    "coalesce": "coalesce({0}, {1})",
}
ROW_PAR = {
    "safediv": lambda a, p: f"(case when abs({a[1]}) >= {_num(p[0])} then {a[0]} / {a[1]} end)",
    "inv": lambda a, p: f"(case when abs({a[0]}) >= {_num(p[0])} then 1 / {a[0]} end)",
    "clip": lambda a, p: f"(case when {a[0]} is not null then greatest({_num(p[0])}, least({_num(p[1])}, {a[0]})) end)",
    "fill": lambda a, p: f"coalesce({a[0]}, {_num(p[0])})",
}


def text(node: Node, known: set[Node]) -> str:
    if node in known:
        return node.key
    if node.op == "field":
        return node.par[0]
    if node.op == "const":
        return _num(node.par[0])
    if node.op == "null":
        return "cast(null as double)"
    args = [text(a, known) for a in node.args]
    return ROW_PAR[node.op](args, node.par) if node.op in ROW_PAR else ROW[node.op].format(*args)


def _time(node: Node, a: list[str], i: str, o: str) -> str:
    op, p, x = node.op, node.par, a[0]
    along = f"(partition by {i} order by {o})"
    so_far = f"(partition by {i} order by {o} rows unbounded preceding)"
    if op in ("lag", "lead"):
        return f"{op}({x}, {p[0]}) over {along}"
    if op == "ffill":
        return f"last_value({x} ignore nulls) over {so_far}"
    if op == "cumsum":
        return f"sum({x}) over {so_far}"
    if op == "last_true":
        return f"{o} - last_value(case when {x} <> 0 then {o} end ignore nulls) over {so_far}"
    if op == "wz":
        w = f"(partition by {i})"
        sd = f"stddev_samp({x}) over {w}"
        return f"case when {sd} > abs(avg({x}) over {w}) * {TINY!r} and {sd} > 0 then ({x} - median({x}) over {w}) / ({sd}) end"
    if op == "ema":
        alpha, adjust, least = p
        b = 1 - alpha
        n = ema_frame(alpha)
        frame = f"(partition by {i} order by {o} rows {n - 1} preceding)"
        # lists keep their nulls here: the place in the list is the age
        own = f"list({x}) over {frame}"
        weighed = f"list_sum([e * pow({_num(b)}, len({own}) - j) for e, j in {own}])"
        if adjust:
            value = f"{weighed} / list_sum([case when e is not null then pow({_num(b)}, len({own}) - j) end for e, j in {own}])"
        else:
            first = f"first_value({x} ignore nulls) over {so_far}"
            age = f"({o} - min(case when {x} is not null then {o} end) over {so_far})"
            value = f"({_num(alpha)} * {weighed} + {_num(b)} * pow({_num(b)}, {age}) * {first})"
        return f"case when count({x}) over {so_far} >= {least} then {value} end"
    n, least = p[0], p[1]
    w = f"(partition by {i} order by {o} rows {n - 1} preceding)"
    enough = f"count({x}) over {w} >= {least}"
    flat = lambda v: f"stddev_pop({v}) over {w} <= abs(avg({v}) over {w}) * {TINY!r}"
    if op in ("corr", "cov"):
        u, v = (f"case when {a[0]} is not null and {a[1]} is not null then {c} end" for c in a)
        enough = f"count({u}) over {w} >= {least}"
        if op == "cov":
            return f"case when {enough} then covar_samp({u}, {v}) over {w} end"
        return f"case when {enough} and not ({flat(u)}) and not ({flat(v)}) then corr({u}, {v}) over {w} end"
    if op == "count":
        return f"cast(count({x}) over {w} as double)"
    if op == "slope":
        return f"case when {enough} and count({x}) over {w} > 1 then regr_slope({x}, {o}) over {w} end"
    if op == "rsq":
        return f"case when {enough} and not ({flat(x)}) then pow(corr({x}, case when {x} is not null then cast({o} as double) end) over {w}, 2) end"
    if op in ("skew", "kurt"):
        f, least_n = ("skewness", 3) if op == "skew" else ("kurtosis", 4)
        return f"case when {enough} and count({x}) over {w} >= {least_n} and not ({flat(x)}) then {f}({x}) over {w} end"
    if op in ("std", "var"):
        sd = f"stddev_samp({x}) over {w}" if p[2] else f"stddev_pop({x}) over {w}"
        sd = f"(case when {sd} <= abs(avg({x}) over {w}) * {TINY!r} then 0.0 else {sd} end)"
        return f"case when {enough} then {sd if op == 'std' else f'{sd} * {sd}'} end"
    if op == "quant":
        return f"case when {enough} then quantile_cont({x}, {_num(p[2])}) over {w} end"
    if op in ("tsrank", "decay", "median"):
        own = f"list({x}) filter ({x} is not null) over {w}"
        if op == "tsrank":
            return f"case when {enough} and {x} is not null then len([e for e in {own} if e < {x}]) + (len([e for e in {own} if e = {x}]) + 1) / 2 end"
        if op == "median":
            return f"case when {enough} then median({x}) over {w} end"
        return f"case when {enough} then list_sum([e * j for e, j in {own}]) / (len({own}) * (len({own}) + 1) / 2) end"
    agg = {"mean": "avg", "sum": "sum", "min": "min", "max": "max"}[op]
    return f"case when {enough} then {agg}({x}) over {w} end"


def _cross(node: Node, a: list[str], i: str, s: str, g: str) -> str:
    op, p, x = node.op, node.par, a[0]
    on = f"{s}, {g}" if op.startswith("g") else s
    w = f"(partition by {on})"
    n = f"count({x}) over {w}"
    if op.startswith("xrank"):
        held = f"partition by {on}, {x} is null order by {x}"
        if op == "xrank_first":
            return f"case when {x} is not null then row_number() over ({held}, {i}) / ({n}) end"
        place = f"(rank() over ({held}) + (count(*) over (partition by {on}, {x}) - 1) / 2)"
        if op == "xrank_no":
            return f"case when {x} is not null then {place} end"
        return f"case when {x} is not null then {place} / ({n}) end" if op == "xrank" else f"case when {x} is not null and {n} >= 2 then ({place} - 0.5) / ({n}) end"
    if op == "xz":
        how, ddof, least = p
        centre = f"median({x}) over {w}" if how == "median" else f"avg({x}) over {w}"
        sd = f"{'stddev_samp' if ddof else 'stddev_pop'}({x}) over {w}"
        return f"case when {n} >= {least} and {sd} > abs(avg({x}) over {w}) * {TINY!r} and {sd} > 0 then ({x} - {centre}) / ({sd}) end"
    if op == "xscale":
        lo, hi = f"min({x}) over {w}", f"max({x}) over {w}"
        return f"case when {x} is null then null when {hi} > {lo} then ({x} - {lo}) / ({hi} - {lo}) else 0.0 end"
    agg = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "count": "count"}[op[1:]]
    return f"cast({agg}({x}) over {w} as double)"


def _parts(base: str, signals: dict[str, Node], keep: list[str], instrument: str, order: str, session: str, group: str, digits: int) -> tuple[list[str], str]:
    known: set[Node] = set()
    ctes, at = [], base
    for number, (what, nodes) in enumerate(schedule(list(signals.values()))):
        inputs = {a: None for n in nodes for a in n.args if a not in known and a.op not in ("field", "const")}
        if inputs:
            ctes.append(f"i{number} as (select *, {', '.join(f'{text(a, known)} as {a.key}' for a in inputs)} from {at})")
            known |= set(inputs)
            at = f"i{number}"
        exprs = []
        for n in nodes:
            args = [text(a, known) for a in n.args]
            exprs.append(f"{_time(n, args, instrument, order) if what == 'time' else _cross(n, args, instrument, session, group)} as {n.key}")
        ctes.append(f"s{number} as (select *, {', '.join(exprs)} from {at})")
        known |= set(nodes)
        at = f"s{number}"
    cols = [*keep, *(f"round(case when isfinite({text(v, known)}) then {text(v, known)} end, {digits}) + 0.0 as {c}" for c, v in signals.items())]
    return ctes, f"select {', '.join(cols)} from {at}"


def select(base: str, signals: dict[str, Node], keep: list[str], instrument: str = "ts_code", order: str = "idx", session: str = "trade_date", group: str = "industry", digits: int = 6) -> str:
    """Common table expressions for ``signals`` over the relation ``base`` (whose own expressions come before) and the final
    select: ``keep`` and each signal, rounded; not finite is null."""
    ctes, last = _parts(base, signals, keep, instrument, order, session, group, digits)
    return "".join(f", {c}" for c in ctes) + " " + last


def named(name: str, base: str, signals: dict[str, Node], keep: list[str], instrument: str = "ts_code", order: str = "idx", session: str = "trade_date", group: str = "industry", digits: int = 6) -> str:
    """The same as further common table expressions, the last of them ``name``."""
    ctes, last = _parts(base, signals, keep, instrument, order, session, group, digits)
    return "".join(f", {c}" for c in [*ctes, f"{name} as ({last})"])
