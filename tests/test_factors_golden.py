"""Library factors against their definitions, written in pandas by hand."""

import numpy as np
import pandas as pd
import pytest

from paneloom.plans import spark_backend as B
from paneloom.plans.factors import FACTORS

RNG = np.random.default_rng(12)
NAMES, DAYS = 14, 270


def market() -> pd.DataFrame:
    parts = []
    for k in range(NAMES):
        c = np.exp(RNG.normal(0, 0.02, DAYS).cumsum()) * 20
        o = np.concatenate([[c[0]], c[:-1]]) * np.exp(RNG.normal(0, 0.01, DAYS))
        h, low = np.maximum(o, c) * 1.01, np.minimum(o, c) * 0.99
        v = RNG.integers(100, 900, DAYS) * 10.0
        parts.append(pd.DataFrame({
            "ts_code": f"{k:02d}", "idx": np.arange(DAYS), "open": o, "high": h, "low": low, "close": c, "pre_close": np.concatenate([[np.nan], c[:-1]]), "volume": v, "amount": v * c / 10,
            "turnover": RNG.random(DAYS) * 3, "pe_ttm": RNG.normal(20, 15, DAYS), "pb": RNG.random(DAYS) * 4, "market_cap": RNG.random(DAYS) * 1e6, "circ_mv": RNG.random(DAYS) * 1e6, "industry": "xyz"[k % 3],
        }))
    return pd.concat(parts, ignore_index=True)


ret = lambda g: g.close / g.close.shift(1) - 1
roll = lambda s, n, m=None: s.rolling(n, min_periods=n if m is None else m)
ew = lambda s, n: s.ewm(span=n, min_periods=n).mean()
cv = lambda g: g.close * g.volume

#: By instrument; a name that ends in * is then standardised across the session by median and deviation, ten values at least.
ALONG = {
    "ret_1m*": lambda g: -(g.close / g.close.shift(20) - 1), "ret_3m*": lambda g: -(g.close / g.close.shift(60) - 1), "ret_1m_skip1m*": lambda g: -(g.close.shift(20) / g.close.shift(40) - 1), "max_ret_1m*": lambda g: -roll(ret(g), 20, 10).max(),
    "ep*": lambda g: 1 / g.pe_ttm.where(g.pe_ttm > 0), "bp*": lambda g: 1 / g.pb.where(g.pb > 0), "vol_1m*": lambda g: -roll(ret(g), 20, 10).std(), "vol_3m*": lambda g: -roll(ret(g), 60, 30).std(), "downside_vol*": lambda g: -roll(ret(g).where(ret(g) <= 0), 60, 20).std(),
    "turnover_cv_20d": lambda g: -roll(g.turnover, 20, 10).std() / roll(g.turnover, 20, 10).mean(), "avg_turnover_1m*": lambda g: -roll(g.turnover, 20, 10).mean(), "avg_turnover_3m*": lambda g: -roll(g.turnover, 60, 30).mean(), "turnover_std*": lambda g: -roll(g.turnover, 20).std(),
    "turnover_change*": lambda g: -(roll(g.turnover, 5).mean() / roll(g.turnover, 20).mean() - 1), "ln_mcap*": lambda g: -np.log(g.market_cap), "ln_circulating_mcap*": lambda g: -np.log(g.circ_mv),
    "high_low_range": lambda g: -roll((g.high - g.low) / g.close, 20, 10).mean(), "short_rev_5d": lambda g: -(g.close / g.close.shift(5) - 1), "volume_ratio": lambda g: -g.volume / roll(g.volume, 5).mean(), "min_ret_1m": lambda g: roll(ret(g), 20, 15).min(),
    "price_position": lambda g: -((g.close - roll(g.low, 60).min()) / (roll(g.high, 60).max() - roll(g.low, 60).min())).clip(0, 1), "volume_breakout": lambda g: -(g.volume / roll(g.volume, 20).mean()).clip(0, 10), "gap_ratio": lambda g: -(g.open / g.close.shift(1) - 1).clip(-0.11, 0.11),
    "upper_shadow": lambda g: -roll((g.high - np.maximum(g.open, g.close)) / (g.high - g.low), 5).mean(), "lower_shadow": lambda g: roll((np.minimum(g.open, g.close) - g.low) / (g.high - g.low), 5).mean(), "volume_cv": lambda g: -(roll(g.volume, 20).std() / roll(g.volume, 20).mean()).clip(0, 5),
    "close_position": lambda g: -roll((g.close - g.low) / (g.high - g.low), 5).mean().clip(0, 1), "downside_capture": lambda g: -(roll(ret(g).clip(upper=0).abs(), 60).sum() / roll(ret(g).abs(), 60).sum()).clip(0, 1), "bias_20": lambda g: -(g.close / roll(g.close, 20).mean() - 1),
    "roc_20": lambda g: -(g.close / g.close.shift(20) - 1), "price_1m": lambda g: -(g.close / roll(g.close, 21).mean() - 1), "vroc_12": lambda g: -(g.volume / g.volume.shift(12) - 1).clip(-1, 10), "skewness_20": lambda g: -roll(ret(g), 20, 10).skew(), "kurtosis_20": lambda g: -roll(ret(g), 20, 10).kurt(),
    "high_52w_rank": lambda g: -g.close / roll(g.close, 250, 60).max(), "high_52w_dist": lambda g: ((roll(g.close, 250, 60).max() - g.close) / roll(g.close, 250, 60).max()).clip(0, 1), "skew_1m": lambda g: -roll(ret(g), 21, 10).skew(), "gap_up": lambda g: g.open / g.close.shift(1) - 1,
    "panic_selling": lambda g: (g.volume / roll(g.volume, 3).mean()).where(g.close / g.close.shift(3) - 1 < 0), "attention_decay": lambda g: -(roll(g.volume, 5).max() / roll(g.volume, 20).mean() - 1).shift(3), "bull_power": lambda g: -(g.high - ew(g.close, 13)) / g.close, "bear_power": lambda g: (g.low - ew(g.close, 13)) / g.close, "vm_diff": lambda g: -((ew(g.volume, 12) - ew(g.volume, 26)) / ew(g.volume, 26)).clip(-5, 5),
    "atr_14": lambda g: -ew(pd.concat([g.high - g.low, (g.high - g.close.shift(1)).abs(), (g.low - g.close.shift(1)).abs()], axis=1).max(axis=1, skipna=False), 14) / g.close,
    "bargaining_power_proxy": lambda g: -roll(ret(g).clip(upper=0), 20).mean(), "volume_stability": lambda g: -roll(g.volume, 20, 10).std() / roll(g.volume, 20, 10).mean(), "volume_climax_reversal": lambda g: -(g.volume / roll(g.volume, 20).mean() - 1).shift(1).clip(lower=0),
    "opening_gap_momentum": lambda g: roll(g.open / g.close.shift(1) - 1, 3).mean(), "intraday_reversal": lambda g: -roll(g.close / g.open - 1, 5).mean(), "range_consistency": lambda g: -roll(g.high / g.low - 1, 20).std(), "volatility_of_volatility": lambda g: -roll(roll(ret(g), 5).std(), 20).std(),
    "relative_spread_proxy": lambda g: -(g.high - g.low) / (g.close + 0.001), "ret_open_2d_proxy": lambda g: roll(g.open / g.close.shift(1) - 1, 2).mean(), "trend_smoothness": lambda g: roll(g.close, 20).corr(pd.Series(np.arange(len(g)), g.index, dtype=float)) ** 2,
    "tvma_20": lambda g: -(cv(g) / roll(cv(g), 20).mean()).clip(0, 10), "money_flow_20": lambda g: -(((g.high + g.low + g.close) / 3 * g.volume) / roll((g.high + g.low + g.close) / 3 * g.volume, 20).mean() - 1).clip(-0.9, 5),
}


def standard(m: pd.DataFrame, values: pd.Series) -> pd.Series:
    own = m.assign(v=values).groupby("idx")["v"]
    return ((values - own.transform("median")) / own.transform("std")).where(own.transform("count") >= 10)


def differences(name: str, got: np.ndarray, want: np.ndarray) -> str | None:
    bad = ~np.isclose(got, want, rtol=1e-6, atol=1e-9, equal_nan=True)
    return f"{name}: {bad.sum()} of {len(bad)}, {got[bad][:2]} for {want[bad][:2]} at row {np.nonzero(bad)[0][:2] % DAYS}" if bad.any() else None


def test_factors_against_their_definitions(spark, monkeypatch):
    monkeypatch.setattr(B, "MANY", -1)
    m = market()
    df = spark.createDataFrame(m.astype(object).where(m.notna(), None).values.tolist(), ", ".join(f"{c} {'string' if c in ('ts_code', 'industry') else 'int' if c == 'idx' else 'double'}" for c in m.columns))
    names = {n.rstrip("*"): n for n in ALONG}
    got = B.evaluate(df, {n: FACTORS[n][1] for n in names}, session="idx").toPandas().sort_values(["ts_code", "idx"]).reset_index(drop=True)
    found = []
    for n, full in names.items():
        with np.errstate(all="ignore"):
            want = m.groupby("ts_code", group_keys=False)[m.columns.tolist()].apply(ALONG[full]).sort_index()
        want = standard(m, want) if full.endswith("*") else want
        found.append(differences(n, got[n].to_numpy(float), want.replace([np.inf, -np.inf], np.nan).to_numpy(float)))
    assert not [x for x in found if x], "\n".join(x for x in found if x)


@pytest.mark.parametrize("name", ["rank_1m", "ideal_amplitude_w_cut_reversal_20d"])
def test_ranked_factors(spark, name):
    m = market()
    df = spark.createDataFrame(m.astype(object).where(m.notna(), None).values.tolist(), ", ".join(f"{c} {'string' if c in ('ts_code', 'industry') else 'int' if c == 'idx' else 'double'}" for c in m.columns))
    got = B.evaluate(df, {"v": FACTORS[name][1]}, session="idx").toPandas().sort_values(["ts_code", "idx"])["v"].to_numpy(float)
    by = m.groupby("ts_code")
    rank = lambda s: m.assign(v=s).groupby("idx")["v"].rank(pct=True)
    pct = lambda k: m.close / by.close.shift(k) - 1
    amplitude = ((m.high - m.low) / by.close.shift(1)).groupby(m.ts_code).transform(lambda s: s.rolling(20).mean())
    want = rank(pct(21)) if name == "rank_1m" else -rank(rank(pct(20)) * rank(amplitude))
    assert not differences(name, got, want.to_numpy(float)) or not differences(name, -got, want.to_numpy(float)), differences(name, got, want.to_numpy(float))
