"""The factor library: every factor is one panel expression, so that a batch shares its windows and shuffles.

``FACTORS`` maps a name to (family, expression). Price and volume factors read the daily panel, REPORTS those of financial
reports read a panel of report periods; its values reach the sessions by an as-of join on the announcement day.
"""

from __future__ import annotations

from functools import reduce

from .nodes import (
    Node, absolute, clip, corr, count, cov, cross_rank, ema, field, fill, fn, greater, high, kurt, lag, ln, low, mean, pct, rsq, skew, slope, smaller, sqrt, std, total, var, where, z,
)

o, h, l, c, v, amount = (field(x) for x in ("open", "high", "low", "close", "volume", "amount"))
turnover, pe, pb, cap, circ = (field(x) for x in ("turnover", "pe_ttm", "pb", "market_cap", "circ_mv"))
r, pc, cv, tp = pct(c), lag(c), c * v, (h + l + c) / 3
market = fn("xmean", r)
up_flag = r > 0
# Large-order flow stands in for a money-flow channel where there is none: amount split by where the close lies in the range.
span = fn("safediv", c - l, h - l, par=(1e-8,))
buy_lg, sell_lg = amount * span, amount * (1 - span)


def win_rate(n: int, least: int | None = None) -> Node:
    return mean(up_flag, n, least)


def _streak() -> Node:
    s = fn("sign", c - o)
    turned = fn("ne", s, fill(lag(s), 9))
    return s * (fn("last_true", turned) + 1)


def _rsi(n: int) -> Node:
    d = c - pc
    up, down = mean(greater(d, 0), n), mean(greater(-d, 0), n)
    return 100 * up / (up + down)


def _auto(n: int, least: int) -> Node:
    both = r * lag(r)
    return (mean(both, n, least) - mean(r, n, least) * mean(lag(r), n, least)) / var(r, n, least)


def _beta() -> Node:
    both = r * market
    return (mean(both, 60) - mean(r, 60) * mean(market, 60)) / var(market, 60)


def spearman(x: Node, y: Node, n: int) -> Node:
    """Closed form over the last n sessions; ties by age, the older one first."""

    def places(a: Node) -> list[Node]:
        back = [lag(a, k) if k else a for k in range(n)]
        return [reduce(lambda s, e: s + e, [(back[j] < back[i]) if j <= i else (back[j] <= back[i]) for j in range(n) if j != i], fn("const", par=(0.0,))) for i in range(n)]

    gaps = [fn("square", a - b) for a, b in zip(places(x), places(y))]
    return 1 - 6 * reduce(lambda s, e: s + e, gaps) / (n * (n * n - 1))


def _boll() -> Node:
    mid, sd = mean(c, 20), std(c, 20)
    return clip((c - (mid - 2 * sd)) / (4 * sd), -0.5, 1.5)


def _vr(n: int) -> Node:
    up, down, flat = (total(where(cond, v, 0), n) for cond in (c > pc, c < pc, fn("eq", c, pc)))
    return clip((up + 0.5 * flat) / (down + 0.5 * flat), 0, 500)


def _triggered(trigger: Node, value: Node) -> Node:
    """``value`` where triggered, 0 elsewhere, null on days without a trigger."""
    return where(fn("xsum", fill(trigger, 0)) > 0, where(fill(trigger, 0), value, 0))


def _market_state() -> Node:
    m20, sd20 = mean(market, 20), std(market, 20)
    return (m20 - mean(m20, 60)) / mean(sd20, 60) * m20 / sd20


true_range = greater(h - l, greater(absolute(h - pc), absolute(l - pc)))
peak_250, mf = high(c, 250, 60), tp * v
vol_change = pct(v)
share20 = total(amount, 20)
amount_share = share20 / fn("xsum", share20)
amplitude = (h - l) / pc
imbalance = (buy_lg - sell_lg) / (buy_lg + sell_lg)
flow_days = total(buy_lg > sell_lg, 10)

FACTORS: dict[str, tuple[str, Node]] = {
    "ret_1m": ("momentum", z(-pct(c, 20))),
    "ret_3m": ("momentum", z(-pct(c, 60))),
    "ret_6m": ("momentum", z(-pct(c, 120))),
    "ret_12m": ("momentum", z(-pct(c, 240))),
    "ret_1m_skip1m": ("momentum", z(-(lag(c, 20) / lag(c, 40) - 1))),
    "max_ret_1m": ("momentum", z(-high(r, 20, 10))),
    "ep": ("value", z(where(pe > 0, 1 / pe))),
    "bp": ("value", z(where(pb > 0, 1 / pb))),
    "vol_1m": ("volatility", z(-std(r, 20, 10))),
    "vol_3m": ("volatility", z(-std(r, 60, 30))),
    "downside_vol": ("volatility", z(-std(where(r <= 0, r), 60, 20))),
    "beta": ("volatility", z(-_beta())),
    "idio_vol": ("volatility", z(-(std(r, 60) * sqrt(1 - fn("square", clip(corr(r, market, 60), -0.999, 0.999)))))),
    "amihud_illiq": ("liquidity", z(mean(absolute(r) / cv, 20, 10) * 1e9)),
    "dollar_vol_20d": ("liquidity", z(-ln(mean(cv, 20, 10)))),
    "dollar_vol_stability": ("liquidity", -(std(cv, 20, 10) / mean(cv, 20, 10))),
    "turnover_cv_20d": ("liquidity", -(std(turnover, 20, 10) / mean(turnover, 20, 10))),
    "turnover_to_vol": ("liquidity", z(-(mean(turnover, 20) / std(r, 20)))),
    "avg_turnover_1m": ("turnover", z(-mean(turnover, 20, 10))),
    "avg_turnover_3m": ("turnover", z(-mean(turnover, 60, 30))),
    "turnover_std": ("turnover", z(-std(turnover, 20))),
    "turnover_change": ("turnover", z(-(mean(turnover, 5) / mean(turnover, 20) - 1))),
    "abnormal_turnover": ("turnover", z(-(mean(turnover, 20) - fn("gmean", mean(turnover, 20))))),
    "ln_mcap": ("size", z(-ln(cap))),
    "ln_circulating_mcap": ("size", z(-ln(circ))),
    "streak": ("momentum", _streak()),
    "rsi_14": ("momentum", -_rsi(14)),
    "high_low_range": ("volatility", -mean((h - l) / c, 20, 10)),
    "vpt": ("liquidity", fn("cumsum", fill(v * r, 0)) / 1e4),
    "short_rev_5d": ("momentum", -pct(c, 5)),
    "boll_pct_b": ("volatility", -_boll()),
    "volume_ratio": ("turnover", -(v / mean(v, 5))),
    "overnight_5d": ("momentum", total(o / pc - 1, 5, 3)),
    "min_ret_1m": ("momentum", low(r, 20, 15)),
    "price_position": ("momentum", -clip((c - low(l, 60)) / (high(h, 60) - low(l, 60)), 0, 1)),
    "volume_breakout": ("turnover", -clip(v / mean(v, 20), 0, 10)),
    "gap_ratio": ("sentiment", -clip((o - pc) / pc, -0.11, 0.11)),
    "upper_shadow": ("pattern", -mean((h - greater(c, o)) / (h - l), 5)),
    "lower_shadow": ("pattern", mean((smaller(c, o) - l) / (h - l), 5)),
    "volume_cv": ("turnover", -clip(std(v, 20) / mean(v, 20), 0, 5)),
    "ret_asymmetry": ("distribution", -clip(mean(greater(r, 0), 20) / mean(greater(-r, 0), 20) - 1, -5, 5)),
    "close_position": ("pattern", -clip(mean((c - l) / (h - l), 5), 0, 1)),
    "downside_capture": ("volatility", -clip(total(greater(-r, 0), 60) / total(absolute(r), 60), 0, 1)),
    "rs_rating": ("momentum", -clip((fn("exp", total(fn("log1p", r), 20)) - 1) - fn("xmean", fn("exp", total(fn("log1p", r), 20)) - 1), -1, 2)),
    "bias_20": ("momentum", -((c - mean(c, 20)) / mean(c, 20))),
    "roc_20": ("momentum", -pct(c, 20)),
    "cci_14": ("momentum", -clip((tp - mean(tp, 14)) / (0.015 * mean(absolute(tp - mean(tp, 14)), 14)), -300, 300)),
    "plrc_12": ("momentum", slope(fill(c / mean(c, 12), 0), 12)),
    "price_1m": ("momentum", -(c / mean(c, 21) - 1)),
    "vr_26": ("sentiment", -_vr(26)),
    "vroc_12": ("sentiment", -clip(pct(v, 12), -1, 10)),
    "psy_12": ("sentiment", -win_rate(12)),
    "money_flow_20": ("sentiment", -clip(mf / mean(mf, 20) - 1, -0.9, 5)),
    "davol_20": ("sentiment", -clip(mean(cv, 20) / mean(cv, 120), 0, 10)),
    "skewness_20": ("distribution", -skew(r, 20, 10)),
    "kurtosis_20": ("distribution", -kurt(r, 20, 10)),
    "sharpe_20": ("distribution", clip((252 * mean(r, 20, 10) - 0.04) / (std(r, 20, 10) * 252**0.5), -5, 5)),
    "atr_14": ("distribution", -(ema(true_range, 14, least=14) / c)),
    "bull_power": ("pattern", -((h - ema(c, 13, least=13)) / c)),
    "bear_power": ("pattern", (l - ema(c, 13, least=13)) / c),
    "high_52w_rank": ("pattern", -(c / peak_250)),
    "rank_1m": ("pattern", cross_rank(pct(c, 21))),
    "vm_diff": ("volume_structure", -clip((ema(v, 12, least=12) - ema(v, 26, least=26)) / ema(v, 26, least=26), -5, 5)),
    "tvma_20": ("volume_structure", -clip(cv / mean(cv, 20), 0, 10)),
    "high_52w_dist": ("distribution", clip((peak_250 - c) / peak_250, 0, 1)),
    "skew_1m": ("distribution", -skew(r, 21, 10)),
    "gap_up": ("momentum", o / pc - 1),
    "panic_selling": ("behavioral", where(pct(c, 3) < 0, v / mean(v, 3))),
    "trend_persistence_score": ("trend_quality", clip(absolute(total(r, 20, 10)) / total(absolute(r), 20, 10) * win_rate(20, 10), 0, 1)),
    "attention_decay": ("behavioral", -lag(high(v, 5) / mean(v, 20) - 1, 3)),
    "earnings_quality_proxy": ("growth_quality", -(std(r, 20) / (absolute(mean(r, 20)) + 0.001) * win_rate(20))),
    "cashflow_matching_proxy": ("growth_quality", mean(pct(c, 20) * pct(cv, 20) > 0, 20)),
    "capital_efficiency_proxy": ("growth_quality", absolute(pct(c, 20)) / mean(cv, 20) * 1e8),
    "operational_efficiency_proxy": ("growth_quality", -_auto(20, 10)),
    "bargaining_power_proxy": ("growth_quality", -mean(smaller(r, 0), 20)),
    "volume_stability": ("volume_structure", -(std(v, 20, 10) / mean(v, 20, 10))),
    "volume_climax_reversal": ("volume_structure", -greater(lag(v / mean(v, 20)) - 1, 0)),
    "opening_gap_momentum": ("momentum", mean(o / pc - 1, 3)),
    "max_drawdown_duration": ("extreme_events", mean(c / high(c, 120), 20)),
    "accrual_quality_proxy": ("fundamental_quality_proxy", -(std(r, 20, 10) / (mean(absolute(r), 20, 10) + 0.001))),
    "intraday_reversal": ("return_decomposition", -mean(c / o - 1, 5)),
    "range_consistency": ("price_pattern", -std(h / l - 1, 20)),
    "volatility_of_volatility": ("volatility_structure", -std(std(r, 5), 20)),
    "relative_spread_proxy": ("liquidity_micro", -((h - l) / (c + 0.001))),
    "trend_smoothness": ("trend_quality", rsq(c, 20)),
    "earnings_consistency_proxy": ("fundamental_quality_proxy", mean(pct(c, 5) > 0, 60)),
    "ret_open_2d_proxy": ("market_microstructure", mean(o / pc - 1, 2)),
    "earnings_season_vol_div": ("earnings_season_divergence", mean(-spearman(r, vol_change, 5), 5, 1)),
    "post_earnings_stability": ("earnings_anomaly", fn("wz", (-smaller(std(r, 5), 0.15)) * clip(ln(mean(c, 5) / mean(c, 20) + 1e-6), -1, 2))),
    "earnings_volume_drift": ("earnings_anomaly", fn("wz", where(pct(c, 5) > 0, clip(pct(c, 5), -1, 1) * clip(-vol_change, -1, 1), 0))),
    "harvey_siddique_coskew": ("market_microstructure", -mean(mean(r * fn("square", market), 60) / (std(r, 60) * mean(fn("square", market), 60)), 5)),
    "market_state_risk_adjusted_momentum": ("market_state_strength", _market_state()),
    "crowded_reversal_5d_large_order_flow": ("conditional_reversal", _triggered(cross_rank(cross_rank(amount_share) * cross_rank(imbalance)) > 0.9, -pct(c, 5))),
    "crowded_amount_reversal_5d": ("conditional_reversal", _triggered(cross_rank(amount_share) > 0.9, -pct(c, 5))),
    "post_list_external_flow_days": ("moneyflow_persistence", where(fn("xcount", flow_days) >= 30, cross_rank(flow_days))),
    "ideal_amplitude_w_cut_reversal_20d": ("amplitude_reversal", -cross_rank(cross_rank(pct(c, 20)) * cross_rank(mean(amplitude, 20)))),
}

# Report periods: one row for an instrument and quarter; lag(x, 4) is the same quarter a year before.
f = {x: field(x) for x in ("revenue", "profit", "assets", "equity", "cash_flow", "debt", "shares", "price", "gross", "current")}
_yoy = lambda x: fn("safediv", x - lag(x, 4), absolute(lag(x, 4)), par=(1e-8,))
_positive = lambda x: where(x > 0, x)
eps, ocfps, bps = f["profit"] / f["shares"], f["cash_flow"] / f["shares"], f["equity"] / f["shares"]
roa_, margin, turn_ = f["profit"] / f["assets"], f["gross"] / f["revenue"], f["revenue"] / f["assets"]


def _f_score() -> Node:
    leverage = f["debt"] / f["assets"]
    tests = [
        roa_ > 0, f["cash_flow"] > 0, roa_ > lag(roa_), f["cash_flow"] > f["profit"], leverage < lag(leverage), f["current"] > lag(f["current"]),
        f["shares"] <= lag(f["shares"]), margin > lag(margin), turn_ > lag(turn_),
    ]
    return reduce(lambda a, b: a + b, [fill(t, 0) for t in tests])


REPORTS: dict[str, tuple[str, Node]] = {
    "sp": ("value", z(_positive(f["revenue"] / f["shares"] / f["price"]))),
    "cfp": ("value", z(_positive(ocfps / f["price"]))),
    "dp": ("value", z(_positive(0.3 * eps / f["price"]))),
    "rev_growth_yoy": ("growth", z(_yoy(f["revenue"]))),
    "earnings_growth_yoy": ("growth", z(fn("coalesce", _yoy(f["profit"]), _yoy(f["gross"])))),
    "asset_growth": ("growth", z(-_yoy(f["assets"]))),
    "f_score": ("profitability", _f_score()),
    "roe": ("profitability", z(f["profit"] / f["equity"])),
    "roa": ("profitability", z(roa_)),
    "roic": ("profitability", z(fn("coalesce", f["profit"] / (f["equity"] + f["debt"]), roa_))),
    "gross_margin": ("profitability", z(margin)),
    "net_margin": ("profitability", z(f["profit"] / f["revenue"])),
    "accruals": ("profitability", z(-((eps - ocfps) / bps))),
    "ocf_quality": ("quality", z(where(eps > 0, ocfps / eps))),
    "debt_coverage": ("quality", z(f["cash_flow"] / f["debt"])),
    "earnings_stability": ("quality", z(-std(_yoy(f["profit"]), 8, 4))),
    "asset_turnover": ("quality", z(turn_)),
}

__all__ = ["FACTORS", "REPORTS", "count", "cov", "kurt"]


def fields_of(node: Node) -> list[str]:
    return sorted({n.par[0] for n in node.walk() if n.op == "field"})


def needs_group(node: Node) -> bool:
    return any(n.op.startswith("g") and n.op in ("gmean", "gsum", "gcount") for n in node.walk())
