"""Typed expression trees: ``{"field": name}`` or ``{"op": ..., "args": [...], "window": n}``, checked before they are compiled.

Units are exponent pairs (price, shares): a price is (1, 0), a share count (0, 1), money (1, 1), a ratio (0, 0).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from .nodes import Node, field, fn, lag

MAX_NODES, MAX_DEPTH, MAX_WINDOW = 64, 12, 252
UNITS = {
    **dict.fromkeys(("open", "high", "low", "close", "pre_close", "up_limit", "down_limit"), (1, 0)),
    "volume": (0, 1), "amount": (1, 1), "market_cap": (1, 1), "circ_mv": (1, 1), "turnover": (0, 0), "pe_ttm": (0, 0), "pb": (0, 0), "adj": (0, 0),
}
TEMPORAL = {"lag": 1, "return": 1, "delta": 1, "mean": 1, "min": 1, "max": 1, "std": 2}
UNARY = ("rank", "zscore", "neg", "abs", "square", "log")
BINARY = ("add", "sub", "mul", "div")


class ExpressionError(ValueError):
    """An expression that is not allowed, and where."""


@dataclass(frozen=True)
class Spec:
    """What is known of a value without computing it."""

    unit: tuple[int, int]
    signed: bool = False  # may be zero or negative
    form: str = "level"  # level, change, rank or score
    horizon: int = 0


def _fail(path: str, why: str):
    raise ExpressionError(f"{path or 'root'}: {why}")


def infer(tree: dict, fields: dict[str, tuple[int, int]] = UNITS, path: str = "") -> Spec:
    """Type of a tree; raises where a rule is broken.

    Time operators take field leaves only and need a window; sums and differences need one unit; a logarithm a positive
    ratio; a denominator must not be able to change its sign or be the numerator itself.
    """
    if not isinstance(tree, dict):
        _fail(path, "not an expression")
    if "field" in tree:
        if set(tree) != {"field"} or tree["field"] not in fields:
            _fail(path, f"unknown field {tree.get('field')!r}")
        return Spec(fields[tree["field"]])
    op, args, window = tree.get("op"), tree.get("args"), tree.get("window")
    if not isinstance(args, list) or set(tree) - {"op", "args", "window"}:
        _fail(path, "malformed node")
    want = 1 if op in TEMPORAL or op in UNARY else 2 if op in BINARY else None
    if want is None or len(args) != want:
        _fail(path, f"operator {op!r} with {len(args)} arguments")
    if (op in TEMPORAL) != (window is not None):
        _fail(path, "a window belongs to time operators, and only to them")
    if op in TEMPORAL:
        if not (isinstance(window, int) and TEMPORAL[op] <= window <= MAX_WINDOW):
            _fail(path, f"window {window!r}")
        if not isinstance(args[0], dict) or "field" not in args[0]:
            _fail(path, "time operators take fields")
    specs = [infer(a, fields, f"{path}/{op}{i}") for i, a in enumerate(args)]
    a = specs[0]
    if op == "return":
        return Spec((0, 0), True, "change", window)
    if op == "delta":
        return replace(a, signed=True, form="change", horizon=window)
    if op in TEMPORAL:
        return replace(a, signed=a.signed or op == "std", horizon=window)
    if op in ("rank", "zscore"):
        return Spec((0, 0), op == "zscore", "rank" if op == "rank" else "score", a.horizon)
    if op == "log":
        if a.unit != (0, 0) or a.signed:
            _fail(path, "log needs a positive ratio")
        return replace(a, signed=True)
    if op == "neg":
        return replace(a, signed=True)
    if op == "abs":
        return replace(a, signed=False)
    if op == "square":
        return Spec((2 * a.unit[0], 2 * a.unit[1]), False, a.form, a.horizon)
    b = specs[1]
    horizon = max(a.horizon, b.horizon)
    if op in ("add", "sub"):
        if a.unit != b.unit:
            _fail(path, f"units {a.unit} and {b.unit}")
        return Spec(a.unit, op == "sub" or a.signed or b.signed, a.form if a.form == b.form else "score", horizon)
    if op == "mul":
        return Spec((a.unit[0] + b.unit[0], a.unit[1] + b.unit[1]), a.signed or b.signed, a.form, horizon)
    if b.signed and b.form != "rank":
        _fail(path, "the denominator may change its sign")
    if args[0] == args[1]:
        _fail(path, "divided by itself")
    return Spec((a.unit[0] - b.unit[0], a.unit[1] - b.unit[1]), a.signed, a.form, horizon)


def allowed_operators(spec: Spec) -> list[str]:
    """Unary operators that may be put over a value of this type: the mask of an incremental generator."""
    return [o for o in UNARY if o != "log" or (spec.unit == (0, 0) and not spec.signed)]


def measure(tree: dict) -> tuple[int, int]:
    """(nodes, depth)."""
    below = [measure(a) for a in tree.get("args", [])]
    return 1 + sum(n for n, _ in below), 1 + max((d for _, d in below), default=0)


def compile_typed(tree: dict | str, fields: dict[str, tuple[int, int]] = UNITS, barrier: bool = False) -> Node:
    """The panel expression of a typed tree. With ``barrier`` (a column that holds the earliest session number an instrument may
    look back to) values whose window begins before it are null."""
    tree = json.loads(tree) if isinstance(tree, str) else tree
    infer(tree, fields)
    nodes, depth = measure(tree)
    if nodes > MAX_NODES or depth > MAX_DEPTH:
        raise ExpressionError(f"{nodes} nodes, depth {depth}: over budget")
    return _node(tree, barrier)


def _node(tree: dict, barrier: bool) -> Node:
    if "field" in tree:
        return field(tree["field"])
    op, w = tree["op"], tree.get("window")
    args = [_node(a, barrier) for a in tree["args"]]
    x = args[0]
    if op in TEMPORAL:
        if op == "lag":
            made, back = lag(x, w), w
        elif op == "return":
            made, back = x / lag(x, w) - 1, w
        elif op == "delta":
            made, back = x - lag(x, w), w
        else:
            made, back = fn(op, x, par=(w, w, 1) if op == "std" else (w, w)), w - 1
        return fn("where", field("idx") - back >= field("barrier"), made, Node("null")) if barrier else made
    if op == "rank":
        return fn("xrank_mid", x)
    if op == "zscore":
        return fn("xz", x, par=("mean", 1, 2))
    return fn(op, *args)


# Six base templates; expand() writes them out over fields and windows.
def _f(name: str) -> dict:
    return {"field": name}


def _op(op: str, *args: dict, window: int | None = None) -> dict:
    return {"op": op, "args": list(args)} | ({"window": window} if window else {})


def templates(windows: tuple[int, ...] = (5, 20)) -> dict[str, dict]:
    """Candidate trees by name; each obeys the type rules."""
    out = {}
    for w in windows:
        out[f"reversal_{w}"] = _op("neg", _op("rank", _op("return", _f("close"), window=w)))
        out[f"volatility_{w}"] = _op("neg", _op("rank", _op("div", _op("std", _f("close"), window=w), _op("mean", _f("close"), window=w))))
        out[f"volume_share_{w}"] = _op("rank", _op("div", _f("volume"), _op("mean", _f("volume"), window=w)))
        out[f"position_{w}"] = _op("zscore", _op("div", _f("close"), _op("max", _f("high"), window=w)))
        out[f"range_{w}"] = _op("neg", _op("zscore", _op("div", _op("sub", _op("max", _f("high"), window=w), _op("min", _f("low"), window=w)), _f("close"))))
        out[f"mixed_{w}"] = _op("add", _op("rank", _op("return", _f("close"), window=w)), _op("rank", _op("delta", _f("turnover"), window=w)))
    return out
