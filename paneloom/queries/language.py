"""One query for each operator of the three expression dialects, and for their templates."""

from __future__ import annotations

from ..plans.forge import build
from ..plans.formula import parse
from ..plans.typed import compile_typed, templates
from .factors import panel_query


def _t(op: str, *args, window: int | None = None) -> dict:
    return {"op": op, "args": [{"field": a} if isinstance(a, str) else a for a in args]} | ({"window": window} if window else {})


_ratio = _t("div", "close", "open")
TYPED = {
    "field": {"field": "close"}, "lag": _t("lag", "close", window=5), "return": _t("return", "close", window=5), "delta": _t("delta", "close", window=5),
    "mean": _t("mean", "close", window=10), "min": _t("min", "low", window=10), "max": _t("max", "high", window=10), "std": _t("std", "close", window=10),
    "rank": _t("rank", "close"), "zscore": _t("zscore", "volume"), "neg": _t("neg", "close"), "abs": _t("abs", _t("delta", "close", window=1)), "square": _t("square", _ratio),
    "log": _t("log", _ratio), "add": _t("add", "open", "close"), "sub": _t("sub", "high", "low"), "mul": _t("mul", _ratio, "turnover"), "div": _t("div", "close", _t("mean", "close", window=20)),
}
FORGE = {
    "add": ("add", "open", "close"), "sub": ("sub", "high", "low"), "mul": ("mul", ("div", "close", "open"), 2.0), "div": ("div", ("sub", "close", "open"), ("sub", "high", "low")),
    "sqrt": ("sqrt", ("sub", "close", "open")), "log": ("log", ("sub", "close", "open")), "abs": ("abs", ("sub", "close", "open")), "neg": ("neg", "close"),
    "square": ("square", ("div", "close", "open")), "cube": ("cube", ("div", "close", "open")), "sign": ("sign", ("sub", "close", "open")), "inv": ("inv", ("sub", "close", "open")),
    "ts_sum": ("ts_sum", "close", 5), "ts_mean": ("ts_mean", "close", 5), "ts_min": ("ts_min", "low", 5), "ts_max": ("ts_max", "high", 5), "ts_std": ("ts_std", "close", 10),
    "ts_delta": ("ts_delta", "close", 3), "ts_pct": ("ts_pct", "close", 3), "ts_rank": ("ts_rank", "close", 10), "ts_zscore": ("ts_zscore", "close", 20),
    "ts_ema_decay": ("ts_ema_decay", "close", 10), "rank": ("rank", "close"), "zscore": ("zscore", "close"), "scale": ("scale", "close"),
    "nested": ("rank", ("ts_mean", ("rank", ("ts_pct", "close", 5)), 10)),
}
TEXT = {
    "infix": "(close - open) / (high - low) * 2", "power": "(close / open) ** 2 - 1", "compare": "(close > open) * 1 + (close >= high) - (close != low) + (close < open) + (close <= low) + (close == open)",
    "unary": "-abs(close - open)", "sqrt": "sqrt(close - open)", "log": "log(close / open)", "log1p": "log1p(close / open - 1)", "exp": "exp(close / open - 1)", "sign": "sign(close - open)",
    "demean": "demean(close, 10)", "normalize": "normalize(close, 20)", "scale": "scale(close)", "zscore": "zscore(close, 20)", "ts_zscore": "ts_zscore(volume, 10)", "cs_zscore": "cs_zscore(close)",
    "rank": "rank(close)", "shift": "close.shift(5)", "ts_delay": "ts_delay(close, 3)", "pct_change": "close.pct_change(5)", "roc": "roc(close, 10)", "diff": "close.diff(2)", "delta": "delta(close, 4)",
    "max_min": "max(close, open) - min(close, open)", "where": "where(close > open, volume, -volume)", "clip": "clip(returns, -0.05, 0.05)", "corr": "corr(close, volume, 10)", "ts_cov": "ts_cov(returns, amplitude, 20)",
    "ma": "ma(close, 5) / ma(close, 20) - 1", "ts_std": "ts_std(returns, 20)", "ts_min_max": "(close - ts_min(low, 20)) / (ts_max(high, 20) - ts_min(low, 20))", "ts_sum": "ts_sum(volume, 5)",
    "ts_skewness": "ts_skewness(returns, 20)", "ts_kurtosis": "ts_kurtosis(returns, 20)", "ema": "ema(close, 12) - ema(close, 26)", "wma": "wma(close, 10)", "ts_rank": "ts_rank(close, 10)", "ts_regression": "ts_regression(close, 10)",
    "ts_decay_linear": "ts_decay_linear(returns, 10)", "cumsum": "cumsum(fillna(returns, 0))", "rolling": "close.rolling(10).mean() / close.rolling(10).std()", "median": "median(close, 7)", "cumprod": "cumprod(1 + fillna(clip(returns, -0.3, 0.3), 0))", "quantile": "quantile(close, 15, 0.3)", "rank01": "rank01(close)",
    "rolling_least": "close.rolling(20, min_periods=5).quantile(0.75) - close.rolling(window=20, min_periods=3).median()", "clip_upper": "returns.clip(upper=0.02)", "cumprod_signs": "cumprod(sign(returns))",
    "lines": "gap = open / close.shift(1) - 1\nquiet = ts_std(returns, 10)\nfactor = rank(-gap) * rank(-quiet)", "derived": "vwap / close - 1 + overnight * hl_ratio",
    "logic": "((close > open) & (volume > ma(volume, 5))) | (high == low)", "nested": "rank(ts_mean(rank(roc(close, 5)), 5) - ts_mean(rank(volume), 5))",
}

QUERIES, SQL = {}, {}
for _prefix, _nodes in (
    ("op_a", {k: compile_typed(v) for k, v in TYPED.items()} | {f"tpl_{k}": compile_typed(v) for k, v in templates().items()}),
    ("op_b", {k: build(v) for k, v in FORGE.items()}),
    ("op_c", {k: parse(v) for k, v in TEXT.items()} | {"compat_scale": parse("scale(close)", compat=True), "compat_cs_zscore": parse("cs_zscore(close, 20)", compat=True)}),
):
    for _name, _node in _nodes.items():
        QUERIES[f"{_prefix}_{_name}"], SQL[f"{_prefix}_{_name}"] = panel_query({"value": _node})
