"""The guarded primitives of tree search: arithmetic that never divides by next to nothing, windows of 2 to 120 full sessions."""

from __future__ import annotations

import random

from .nodes import Node, ema, fn, lag, wrap

EPS = 1e-8
WINDOWS = (3, 5, 10, 20, 40, 60)
CONSTANTS = (-1.0, -0.5, 0.0, 0.5, 1.0, 2.0)
FIELDS = ("open", "high", "low", "close", "volume")


def _w(n: float, lo: int = 2, hi: int = 120) -> int:
    return max(lo, min(hi, int(n)))


PRIMITIVES = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b,
    "div": lambda a, b: fn("safediv", a, b, par=(EPS,)),
    "sqrt": lambda a: fn("sqrt", fn("max2", a, 0)),
    "log": lambda a: fn("log", fn("max2", a, EPS)),
    "abs": lambda a: fn("abs", a), "neg": lambda a: -a, "square": lambda a: fn("square", a), "cube": lambda a: fn("cube", a), "sign": lambda a: fn("sign", a),
    "inv": lambda a: fn("inv", a, par=(EPS,)),
    "ts_sum": lambda a, n: fn("sum", a, par=(_w(n), _w(n))), "ts_mean": lambda a, n: fn("mean", a, par=(_w(n), _w(n))),
    "ts_min": lambda a, n: fn("min", a, par=(_w(n), _w(n))), "ts_max": lambda a, n: fn("max", a, par=(_w(n), _w(n))),
    "ts_std": lambda a, n: fn("std", a, par=(_w(n), _w(n), 0)),
    "ts_delta": lambda a, n: a - lag(a, _w(n)),
    "ts_pct": lambda a, n: fn("safediv", a - lag(a, _w(n)), lag(a, _w(n)), par=(EPS,)),
    "ts_rank": lambda a, n: fn("tsrank", a, par=(_w(n), _w(n))) / _w(n),
    "ts_zscore": lambda a, n: (a - fn("mean", a, par=(_w(n), _w(n)))) / fn("std", a, par=(_w(n), _w(n), 0)),
    "ts_ema_decay": lambda a, n: a - ema(a, _w(n, 5, 60), adjust=False),
    "rank": lambda a: fn("xrank_first", a),
    "zscore": lambda a: fn("xz", a, par=("mean", 0, 1)),
    "scale": lambda a: fn("xscale", a),
}
ARITY = {name: (2 if name in ("add", "sub", "mul", "div") else 1) for name in PRIMITIVES}


def build(tree) -> Node:
    """A tree is a field name, a number, or (primitive, argument, ...); windows must be literal numbers."""
    if isinstance(tree, str):
        return Node("field", (), (tree,))
    if isinstance(tree, (int, float)):
        return wrap(tree)
    name, *args = tree
    if name not in PRIMITIVES:
        raise ValueError(f"unknown primitive {name}")
    if name.startswith("ts_") and not isinstance(args[-1], (int, float)):
        raise ValueError(f"{name}: the window must be a number")
    tail = [args.pop()] if name.startswith("ts_") else []
    return PRIMITIVES[name](*(build(a) for a in args), *tail)


def grow(rng: random.Random, depth: int, full: bool = False):
    """A random tree: ``full`` ones have all leaves at ``depth``, others may end earlier."""
    if depth <= 0 or (not full and rng.random() < 0.25):
        return rng.choice(FIELDS) if rng.random() < 0.85 else rng.choice(CONSTANTS)
    name = rng.choice(sorted(PRIMITIVES))
    args = [grow(rng, depth - 1, full) for _ in range(ARITY[name])]
    return (name, *args, rng.choice(WINDOWS)) if name.startswith("ts_") else (name, *args)


def simplify(tree):
    """Folds what is certain: double negation, x - x, x * 0, x * 1, x + 0, time operators over constants."""
    if not isinstance(tree, tuple):
        return tree
    name, *args = tree
    args = [simplify(a) for a in args]
    constant = lambda t: isinstance(t, (int, float))
    if name == "neg" and isinstance(args[0], tuple) and args[0][0] == "neg":
        return args[0][1]
    if name == "sub" and args[0] == args[1]:
        return 0.0
    if name == "mul" and 0.0 in [a for a in args if constant(a)]:
        return 0.0
    for own, other in ((0, 1), (1, 0)):
        if name == "mul" and constant(args[own]) and args[own] == 1 or name == "add" and constant(args[own]) and args[own] == 0:
            return args[other]
    if name in ("ts_mean", "ts_min", "ts_max") and constant(args[0]):
        return args[0]
    if name in ("ts_std", "ts_delta") and constant(args[0]):
        return 0.0
    return (name, *args)
