"""The two ways of evaluating signals give the same values: window columns, and matrices of instruments and whole sessions."""

import numpy as np

from paneloom.plans import spark_backend as B
from paneloom.plans.factors import FACTORS, fields_of
from paneloom.plans.nodes import field, fn
from paneloom.queries.factors import QUERIES
from paneloom.sources.panel import dense_panel

C, V = field("close"), field("volume")
OPERATORS = {
    **{f"t_{op}": fn(op, C, par=(9, 4)) for op in ("mean", "sum", "min", "max", "count", "skew", "kurt", "slope", "rsq", "tsrank", "median", "decay")},
    "t_quant": fn("quant", C, par=(9, 4, 0.3)), "t_std": fn("std", C, par=(9, 4, 1)), "t_sdp": fn("std", C, par=(9, 4, 0)), "t_corr": fn("corr", C, V, par=(12, 5)), "t_cov": fn("cov", C, V, par=(12, 5)),
    "t_lag": fn("lag", C, par=(3,)), "t_lead": fn("lead", C, par=(2,)), "t_ffill": fn("ffill", C), "t_cumsum": fn("cumsum", C), "t_last": fn("last_true", C > 20), "t_wz": fn("wz", fn("where", C > 20, C, field("open"))),
    "t_ema": fn("ema", C, par=(0.2, True, 3)), "t_ewm": fn("ema", C, par=(0.2, False, 3)),
    **{f"c_{op}": fn(op, C) for op in ("xrank", "xrank_mid", "xrank_first", "xrank_no", "xscale", "xmean", "xsum", "xmin", "xmax", "xcount", "gmean", "gsum", "gcount")},
    "c_z": fn("xz", C, par=("mean", 1, 3)), "c_zm": fn("xz", C, par=("median", 0, 3)), "n_mixed": fn("mean", fn("xrank", fn("lag", C, par=(1,)) / C), par=(5, 2)),
    "r_logic": fn("or", fn("and", C > 20, V > 1e5), fn("eq", C, C)), "r_if": fn("where", fn("lag", C, par=(1,)) > C, fn("clip", C, par=(0.0, 30.0)), -C), "r_pow": fn("pow", C, fn("const", par=(0.5,))),
}


def test_operators_and_factors_agree(spark, sf, monkeypatch):
    signals = OPERATORS | {n: node for n, (_, node) in list(FACTORS.items())[::9]}
    fields = sorted({f for n in signals.values() for f in fields_of(n)} | {"open"})
    panel = dense_panel(spark, sf, fields, True).cache()
    got = {}
    for many in (-1, 10**9):
        monkeypatch.setattr(B, "MANY", many)
        got[many] = B.evaluate(panel, signals).toPandas().sort_values(["ts_code", "idx"]).reset_index(drop=True)
    for name in signals:
        a, b = (got[m][name].to_numpy(float) for m in (-1, 10**9))
        assert np.array_equal(np.isnan(a), np.isnan(b)), name
        assert np.allclose(a, b, rtol=1e-8, atol=1e-9, equal_nan=True), (name, np.nanmax(np.abs(a - b)))
    panel.unpersist()


def test_empty_panel(spark, sf, monkeypatch):
    monkeypatch.setattr(B, "MANY", -1)
    panel = dense_panel(spark, sf, ["close"]).limit(0)
    assert B.evaluate(panel, {"a": fn("mean", C, par=(3, 1)), "b": fn("xrank", C)}).count() == 0


def widest_shuffle(df):
    """Most columns that an exchange of the plan moves."""
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            found.append(node.output().size())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


def test_batch_moves_narrow_rows(spark, sf):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan hides its exchanges
    try:
        assert widest_shuffle(QUERIES["fac_batch"](spark, sf)) < 50
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_inputs_to_sessions_and_numbers_back_agree(spark, sf, monkeypatch):
    """Without a time operator over ranks: wide rows stay with their instrument. Cached panels lie in any way."""
    signals = {n: node for n, node in OPERATORS.items() if n != "n_mixed"} | {n: node for n, (_, node) in FACTORS.items() if any(m.op in B.CROSS for m in node.walk())}
    fields = sorted({f for n in signals.values() for f in fields_of(n)} | {"open"})
    panel = dense_panel(spark, sf, fields, True).cache()
    got = {}
    for many in (-1, 10**9):
        monkeypatch.setattr(B, "MANY", many)
        got[many] = B.evaluate(panel, signals).toPandas().sort_values(["ts_code", "idx"]).reset_index(drop=True)
    assert list(got[-1].columns) == list(got[10**9].columns) and len(got[-1]) == len(got[10**9])
    for name in signals:
        a, b = (got[m][name].to_numpy(float) for m in (-1, 10**9))
        assert np.array_equal(np.isnan(a), np.isnan(b)), name
        assert np.allclose(a, b, rtol=1e-8, atol=1e-9, equal_nan=True), (name, np.nanmax(np.abs(a - b)))
    panel.unpersist()
