"""Trading signals: for each indicator a buy and a sell condition that hold on the day of a crossing, as panel expressions.

Signals are 1 or 0; an instrument's first sessions, in which an indicator has no history, are 0, and so is whatever a missing
price leaves undefined. The parabolic stop is a state machine and has its own scan (``operators.simulation.parabolic_stop``).
"""

from __future__ import annotations

from .factors import c, h, l, o, tp, v
from .nodes import Node, absolute, ema, ema_alpha, fill, fn, greater, high, lag, low, mean, std, total, where

position = fn("cumsum", fill(c, 0) * 0 + 1)
back = fn("coalesce", lag(c), c)  # the first session is compared with itself


def both(a: Node, b: Node) -> Node:
    return fn("and", a, b)


def either(a: Node, b: Node) -> Node:
    return fn("or", a, b)


#: Differences below this are rounding, not crossings.
NOISE = 1e-9


def _gap(x: Node, y) -> Node:
    return x - (y if isinstance(y, Node) else fn("const", par=(float(y),)))


def over(x: Node, y) -> Node:
    """x rises above y."""
    gap = _gap(x, y)
    return both(gap > NOISE, lag(gap) <= NOISE)


def under(x: Node, y) -> Node:
    gap = _gap(x, y)
    return both(gap < -NOISE, lag(gap) >= -NOISE)


def begins(x: Node) -> Node:
    """A condition holds that did not hold the session before."""
    return both(x, fn("eq", lag(x), 0))


def _strength(x: Node, n: int) -> Node:
    d = x - fn("coalesce", lag(x), x)
    gain, loss = mean(greater(d, 0), n), mean(greater(-d, 0), n)
    return 100 - 100 / (1 + where(loss > 0, gain / loss, 100))


def _band(n: int, k: float) -> tuple[Node, Node, Node]:
    mid, sd = mean(c, n), std(c, n)
    return mid, mid + k * sd, mid - k * sd


def _macd(a: int, b: int, s: int) -> tuple[Node, Node]:
    dif = ema(c, a, adjust=False) - ema(c, b, adjust=False)
    return dif, ema(dif, s, adjust=False)


def _range_place(n: int) -> Node:
    top, bottom = high(h, n), low(l, n)
    return where(fn("ne", top, bottom), 100 * (c - bottom) / (top - bottom), 50)


def _k(n: int, m: int) -> Node:
    return ema_alpha(where(position > n, _range_place(n), 50), 1 / m)


def _moves() -> tuple[Node, Node, Node]:
    up, down = h - lag(h), lag(l) - l
    first = position <= 1
    rise = where(first, 0, where(both(up > 0, up > down), up, 0))
    fall = where(first, 0, where(both(down > 0, down > up), down, 0))
    spread = where(first, 0, greater(h - l, greater(absolute(h - lag(c)), absolute(l - lag(c)))))
    return rise, fall, spread


def _ratio(a: Node, b: Node, n: int) -> Node:
    top, bottom = total(greater(a, 0), n), total(greater(b, 0), n)
    return where(bottom > 0, 100 * top / bottom, 100)


def _flow(n: int) -> Node:
    mf = tp * v
    was = lag(mf)
    inn, out = total(where(position <= 1, 0, where(mf > was, mf, 0)), n), total(where(position <= 1, 0, where(mf < was, mf, 0)), n)
    return where(out > 0, 100 - 100 / (1 + inn / out), 50)


def _finite_weights(n: int, decay: float) -> Node:
    weights = [(1 - decay) * decay**j for j in range(n)]
    out = c * (weights[0] / sum(weights))
    for j in range(1, n):
        out = out + lag(c, j) * (weights[j] / sum(weights))
    return where(position > n, out, fn("cumsum", c) / position)


def _build() -> dict[str, tuple[Node, Node, int]]:
    dif, dea = _macd(12, 26, 9)
    bull = both(dif - dea > NOISE, dif > NOISE)
    smooth = c
    for _ in range(3):
        smooth = ema(smooth, 12, adjust=False)
    trix = where(position <= 1, 0, 100 * (smooth - lag(smooth)) / greater(absolute(lag(smooth)), 1e-8))
    mid, upper, lower = _band(20, 2.0)
    mtm = where(position > 12, c - lag(c, 12), 0)
    rise, fall, spread = (total(x, 7) for x in _moves())
    pdi, ndi = (where(spread > 0, 100 * x / spread, 0) for x in (rise, fall))
    line = (high(h, 20) + low(l, 20)) / 2
    wms = where(fn("ne", high(h, 14), low(l, 14)), 100 * (high(h, 14) - c) / (high(h, 14) - low(l, 14)), 50)
    k, d = _k(9, 3), None
    d = ema_alpha(where(position > 9, k, 50), 1 / 3)
    psy = 100 * total(c > back, 12) / 12
    ar, br = _ratio(h - o, o - l, 26), _ratio(h - back, back - l, 26)
    cold, hot = either(ar < 60, br < 50), either(ar > 140, br > 150)
    e20 = ema(c, 20, adjust=False)
    ew = _finite_weights(20, 0.94)
    return {
        "sma": (over(c, mean(c, 20)), under(c, mean(c, 20)), 1),
        "ema": (over(c, e20), under(c, e20), 1),
        "expma": (over(c, ema_alpha(c, 2 / 21)), under(c, ema_alpha(c, 2 / 21)), 1),
        "ewma": (over(c, ew), under(c, ew), 1),
        "ma_cross": (over(mean(c, 5), mean(c, 20)), under(mean(c, 5), mean(c, 20)), 20),
        "macd": (over(dif, dea), under(dif, dea), 26),
        "macd_v2": (begins(bull), begins(fn("eq", bull, 0)), 1),
        "trix": (over(trix, mean(trix, 20)), under(trix, mean(trix, 20)), 32),
        "boll": (over(c, lower), either(under(c, mid), under(c, upper)), 20),
        "boll_v2": (over(c, mid), either(under(c, upper), under(c, mid)), 20),
        "mtm": (over(mtm, mean(mtm, 6)), under(mtm, mean(mtm, 6)), 18),
        "dmi": (over(pdi, ndi), under(pdi, ndi), 7),
        "hl": (over(c, line), under(c, line), 20),
        "wms": (over(wms, 80), under(wms, 20), 14),
        "kdj": (over(k, d), under(k, d), 9),
        "kdj_v2": (under(k, 20), over(k, 80), 9),
        "rsi": (under(_strength(c, 14), 30), over(_strength(c, 14), 70), 14),
        "rsi_cr": (over(_strength(c, 6), _strength(c, 24)), under(_strength(c, 6), _strength(c, 24)), 24),
        "psy": (under(psy, 25), over(psy, 75), 12),
        "arbr": (begins(cold), begins(hot), 26),
        "mfi": (under(_flow(14), 20), over(_flow(14), 80), 14),
        "vrsi": (under(_strength(v, 6), 15), over(_strength(v, 6), 85), 6),
    }


def signals() -> dict[str, tuple[Node, Node]]:
    """name -> (buy, sell), zero in the warm-up."""
    ready = lambda cond, warm: fill(where(position > warm, cond, 0), 0)
    return {name: (ready(buy, warm), ready(sell, warm)) for name, (buy, sell, warm) in _build().items()}
