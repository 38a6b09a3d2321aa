"""Panel expressions: a small algebra over (instrument, session) panels, with two back ends.

A :class:`Node` is a field, a constant or an operator over nodes. Row operators need one row; time operators look back along
an instrument's sessions; cross operators look across a session; group operators across a session and a group column.
Nodes are values: equal expressions are equal nodes and are computed once, however many signals share them.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cached_property


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple[Node, ...] = ()
    par: tuple = ()

    @cached_property
    def key(self) -> str:
        """Content hash: a cache key and the name of the node's column."""
        return "n" + hashlib.sha256(self.canonical().encode()).hexdigest()[:16]

    def canonical(self) -> str:
        return json.dumps(self.tree(), separators=(",", ":"), sort_keys=True)

    def tree(self) -> list:
        return [self.op, list(self.par), [a.tree() for a in self.args]]

    def walk(self):
        for a in self.args:
            yield from a.walk()
        yield self

    @property
    def size(self) -> int:
        return 1 + sum(a.size for a in self.args)

    @property
    def depth(self) -> int:
        return 1 + max((a.depth for a in self.args), default=0)

    @property
    def lookback(self) -> int:
        """Sessions before the first wanted one that must be read; filters on the session are widened by it."""
        own = 0
        if self.op in LOOKS:
            own = LOOKS[self.op](self.par)
        return own + max((a.lookback for a in self.args), default=0)

    def __add__(self, o):
        return Node("add", (self, wrap(o)))

    def __radd__(self, o):
        return Node("add", (wrap(o), self))

    def __sub__(self, o):
        return Node("sub", (self, wrap(o)))

    def __rsub__(self, o):
        return Node("sub", (wrap(o), self))

    def __mul__(self, o):
        return Node("mul", (self, wrap(o)))

    def __rmul__(self, o):
        return Node("mul", (wrap(o), self))

    def __truediv__(self, o):
        return Node("div", (self, wrap(o)))

    def __rtruediv__(self, o):
        return Node("div", (wrap(o), self))

    def __neg__(self):
        return Node("neg", (self,))

    def __gt__(self, o):
        return Node("gt", (self, wrap(o)))

    def __lt__(self, o):
        return Node("lt", (self, wrap(o)))

    def __ge__(self, o):
        return Node("ge", (self, wrap(o)))

    def __le__(self, o):
        return Node("le", (self, wrap(o)))


def wrap(x) -> Node:
    return x if isinstance(x, Node) else Node("const", (), (float(x),))


def field(name: str) -> Node:
    return Node("field", (), (name,))


def fn(op: str, *args, par: tuple = ()) -> Node:
    return Node(op, tuple(wrap(a) for a in args), par)


#: How many sessions before its own an operator reads.
LOOKS = {
    "lag": lambda p: p[0],
    **{op: (lambda p: p[0] - 1) for op in ("mean", "sum", "min", "max", "std", "var", "count", "skew", "kurt", "tsrank", "slope", "rsq", "corr", "cov", "decay", "median", "quant")},
    "ema": lambda p: 252, "cumsum": lambda p: 252, "ffill": lambda p: 252, "streak": lambda p: 252, "last_true": lambda p: 252,
}


# Builders. ``n`` is a window in sessions, ``least`` how many values it must hold (all of them unless given).
def lag(x, k=1):
    return fn("lag", x, par=(int(k),))


def pct(x, k=1):
    return x / lag(x, k) - 1


def _rolling(op):
    def build(x, n, least=None, **kw):
        return fn(op, x, par=(int(n), int(n if least is None else least), *kw.values()))

    return build


mean, total, low, high = _rolling("mean"), _rolling("sum"), _rolling("min"), _rolling("max")
count, skew, kurt, slope, rsq, tsrank, decay, median = (_rolling(o) for o in ("count", "skew", "kurt", "slope", "rsq", "tsrank", "decay", "median"))


def quantile(x, n, q, least=None):
    return fn("quant", x, par=(int(n), int(n if least is None else least), float(q)))


def std(x, n, least=None, ddof=1):
    return fn("std", x, par=(int(n), int(n if least is None else least), ddof))


def var(x, n, least=None, ddof=1):
    return fn("var", x, par=(int(n), int(n if least is None else least), ddof))


def corr(x, y, n, least=None):
    return fn("corr", x, y, par=(int(n), int(n if least is None else least)))


def cov(x, y, n, least=None):
    return fn("cov", x, y, par=(int(n), int(n if least is None else least)))


def ema(x, span, adjust=True, least=1):
    """Exponential mean with alpha = 2 / (span + 1); positions count, nulls have no weight."""
    return fn("ema", x, par=(float(2 / (span + 1)), bool(adjust), int(least)))


def ema_alpha(x, alpha, adjust=False, least=1):
    return fn("ema", x, par=(float(alpha), bool(adjust), int(least)))


def where(cond, a, b=None):
    return fn("where", cond, a, b if b is not None else Node("null"))


def clip(x, lo, hi):
    return fn("clip", x, par=(float(lo), float(hi)))


def fill(x, value=0.0):
    return fn("fill", x, par=(float(value),))


def absolute(x):
    return fn("abs", x)


def ln(x):
    return fn("log", x)


def sqrt(x):
    return fn("sqrt", x)


def greater(a, b):
    return fn("max2", a, b)


def smaller(a, b):
    return fn("min2", a, b)


def cross_rank(x):
    """Average rank over count."""
    return fn("xrank", x)


def z(x, least=10):
    """Robust standard score across the session: median centre, sample deviation, null where a day has too few values."""
    return fn("xz", x, par=("median", 1, least))
