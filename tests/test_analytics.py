import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import inference as I
from paneloom.operators import models as M
from paneloom.operators import relational as R
from paneloom.operators import simulation as X
from paneloom.operators import statistics as S


def scored(spark, rows):
    return spark.createDataFrame(rows, "ts_code string, trade_date string, score double, label double")


def test_perfect_and_constant_signals(spark):
    rows = [(f"s{i}", "1", float(i), i * 0.01) for i in range(6)] + [(f"s{i}", "2", 1.0, i * 0.01) for i in range(6)] + [("s0", "3", 1.0, 1.0), ("s1", "3", None, 1.0)]
    got = {r["trade_date"]: r for r in S.rank_ic(scored(spark, rows), ["trade_date"]).collect()}
    assert got["1"]["pearson"] == pytest.approx(1) and got["1"]["spearman"] == pytest.approx(1)
    assert got["2"]["spearman"] is None and got["3"]["spearman"] is None


def test_five_rising_groups(spark):
    rows = [(f"s{i:02d}", str(d), float(i), (i // 4) * 0.002) for i in range(20) for d in range(8)]
    m = S.monotonicity(S.quantile_returns(scored(spark, rows), "trade_date", "score", "label", 5, 15)).first()
    assert m["order"] == pytest.approx(1) and m["rising"] == 1.0 and m["spread"] == pytest.approx(0.008)


def test_normal_scores_and_weights(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (1.0,), (None,)], "p double")
    got = [r[0] for r in df.select(S.normal_scores(F.col("p"))).collect()]
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(-got[2]) and got[3] is None
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    w = S.equal_risk(cov)
    assert np.ptp(w * (cov @ w)) < 1e-9 and w.sum() == pytest.approx(1)
    for f in (S.inverse_variance, S.hierarchical_risk):
        assert f(cov).sum() == pytest.approx(1) and f(cov)[0] > f(cov)[2]
    assert sum(S.softmax_top({"a": 1.0, "b": 2.0, "c": 0.0}, 2).values()) == pytest.approx(1)


def test_bootstrap(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, None if i % 17 == 0 else rng.gauss(0.05, 0.1)) for i in range(200)], "i int, v double")
    means = I.block_bootstrap(df, "i", "v", 10, 400)
    out = I.bootstrap_interval(means).first()
    assert out["low"] < 0.05 < out["high"] and out["p"] < 0.05
    again = I.block_bootstrap(df, "i", "v", 10, 400)
    assert sorted(means.collect()) == sorted(again.collect())
    assert I.block_bootstrap(df.limit(0), "i", "v", 10, 3).filter("mean is not null").count() == 0


def test_driver_statistics():
    assert I.required_sections(0.02, 0.1) == math.ceil((2.8015852 * 5) ** 2)
    rng = np.random.default_rng(0)
    noise = rng.normal(0, 1, (240, 10))
    good = noise + np.arange(10) * 0.5
    assert I.overfitting_probability(good) < 0.1 < I.overfitting_probability(noise)
    points = np.array([[1, 1], [2, 2], [0, 3], [0, 0]])
    assert I.fronts(points).tolist() == [1, 0, 0, 2]
    assert np.isinf(I.crowding(points)[[1, 2]]).any()
    assert I.upper_confidence({"a": (10, 0.1), "b": (0, 0.0)}) == "b"


def test_bootstrap_against_brute_force(spark):
    """The sums of a replicate, value by value, from the same draws."""
    import hashlib

    v = [None if i % 11 == 0 else math.sin(i) for i in range(53)]
    got = {r["replicate"]: r for r in I.block_bootstrap(spark.createDataFrame(list(enumerate(v)), "i int, v double"), "i", "v", 10, 20).collect()}
    for rep in range(20):
        drawn = []
        for j in range(6):
            a = int(hashlib.md5(f"7|{rep}|{j}".encode()).hexdigest()[:8], 16) % 53
            drawn += [v[(a + k) % 53] for k in range(10 if j < 5 else 3)]
        own = np.array([x for x in drawn if x is not None])
        assert got[rep]["mean"] == pytest.approx(own.mean()) and got[rep]["sd"] == pytest.approx(own.std(ddof=1))
    noise = np.random.default_rng(0).normal(0.1, 0.1, 200)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(noise)], "i int, v double")
    assert I.lower_icir_bound(df, "i", "v", 10).first()["bound"] > 0
    worse = df.withColumn("v", F.col("v") - 0.05)
    a, b = (I.deflated_sharpe(x, "v", 100, 0.05).first()["probability"] for x in (worse, df))
    assert 0 < a < b <= 1 and I.deflated_sharpe(df.limit(0), "v", 100, 0.05).first()["probability"] is None


def test_normal_distribution(spark):
    from statistics import NormalDist

    from paneloom.functions import normal

    z = [-8.0, -3.0, -0.5, 0.0, 1.0, 4.0]
    p = [0.0, 1e-6, 0.01, 0.3, 0.5, 0.975, 1 - 1e-6, 1.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(normal.below(F.col("z")), normal.two_sided(F.col("z"))).collect()
    assert all(r[0] == pytest.approx(NormalDist().cdf(x), rel=3e-7) and r[1] == pytest.approx(2 * NormalDist().cdf(-abs(x)), rel=3e-7) for x, r in zip(z, got))
    back = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(normal.quantile(F.col("p"))).collect()]
    assert back[0] is None and back[-1] is None and all(a == pytest.approx(NormalDist().inv_cdf(x), abs=1e-7) for x, a in list(zip(p, back))[1:-1])


def test_residuals_are_orthogonal(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", str(d), a := rng.random(), 2 * a + rng.random()) for i in range(30) for d in range(3)]
    out = M.residual_on(scored(spark, rows), "trade_date", "label", ["score"]).join(scored(spark, rows), ["ts_code", "trade_date"])
    assert abs(out.agg(F.sum(F.col("residual") * F.col("score"))).first()[0]) < 1e-9


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, []), (502, [0.0] * 8)], "k long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {(r["query"], r["rank"]): r["neighbour"] for r in M.nearest(df, "k", "v", 3, every=10, block=5).collect()}
    for q in range(0, 120, 10):
        order = [i for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:3]
        assert [got[q, k + 1] for k in range(3)] == order


def test_asof_against_brute_force(spark):
    rng = random.Random(6)
    facts = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(2000)]), i, rng.choice([None, float(i)])) for i in range(150)]
    asked = [(rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(2200)]), i) for i in range(150)]
    left, right = spark.createDataFrame(asked, "k string, t int, i int"), spark.createDataFrame(facts, "k string, s int, n int, v double")
    for strict, tolerance in ((False, None), (True, None), (False, 100)):
        got = {r["i"]: (r["s"], r["v"]) for r in R.asof(left, right, "k", "t", "s", ["v"], ["n"], tolerance, strict, tile=64).collect()}
        for k, t, i in asked:
            held = [(s, n, v) for x, s, n, v in facts if x == k and k is not None and t is not None and s is not None and (s < t if strict else s <= t)]
            best = max(held, key=lambda e: e[:2]) if held else None
            if best is None or (tolerance is not None and t - best[0] > tolerance):
                assert got[i] == (None, None)
            else:
                assert got[i] == (best[0], best[2])
        assert len(got) == len(asked)


def test_account_conserves_money():
    a = X.Account("100000", slippage="0", least_commission="0", commission="0", tax="0")
    bar = lambda p: {"open": Decimal(p), "close": Decimal(p), "before": Decimal(10**7), "up": None, "down": None}
    assert a.trade({"600000.SH": bar("10")}, {"600000.SH": 0.5}) == 1
    assert a.shares == {"600000.SH": 5000} and a.cash == Decimal("50000")
    assert a.value({"600000.SH": bar("12")}, "close") == Decimal("110000")
    a.begin(2)
    assert a.trade({"600000.SH": bar("12")}, {}) == 1 and a.cash == Decimal("110000") and not a.shares
    stopped = bar("10") | {"up": Decimal("10")}
    assert a.trade({"600000.SH": stopped}, {"600000.SH": 0.5}) == 0 and a.refused == 1


def test_turnover_budget_and_stop(spark):
    rows = [("x", 1, "a", 0.5), ("x", 1, "b", 0.5), ("x", 2, "c", 1.0)]
    out = X.turnover_limited(spark.createDataFrame(rows, "account string, d int, k string, weight double"), "account", "d", "k", "weight", 1.0).collect()
    two = {r["k"]: r["weight"] for r in out if r["d"] == 2}
    assert two == {"a": 0.25, "b": 0.25, "c": 0.5}
    prices = [10 + i for i in range(10)] + [19 - i for i in range(10)]
    df = spark.createDataFrame([("a", i, p + 0.5, p - 0.5) for i, p in enumerate(prices)], "ts_code string, idx int, high double, low double")
    sells = [r["idx"] for r in X.parabolic_stop(df).filter("sell = 1").collect()]
    assert len(sells) == 1 and sells[0] > 9


def test_regimes():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(-1, 0.3, 100), rng.normal(1, 0.3, 100)])
    states, means = M.regimes_by_mixture(x, (2, 3))
    assert states[:95].mean() < 0.5 < states[105:].mean() and means[0] < means[-1]


def test_boosted_trees_walk_forward(spark):
    """The relation turns at session 40: only a model that is fitted again follows it."""
    from paneloom.operators import models as M

    rows = [(f"s{i}", t, float(i), float(i if t < 40 else 9 - i)) for i in range(10) for t in range(150)]
    made = M.walk_forward_trees(spark.createDataFrame(rows, "ts_code string, idx int, x double, y double"), "idx", ["x"], "y", 20, 5, 60, 3).collect()
    assert {r["idx"] for r in made} == set(range(25, 150)) and len(made) == 1250
    at = {(r["ts_code"], r["idx"]): r["prediction"] for r in made}
    assert at["s9", 30] > at["s0", 30] and at["s9", 149] < at["s0", 149]


def test_price_volume_features_against_the_definition(spark, sf):
    import __spark_entry__ as entry
    from compare import assert_same, connect
    from paneloom.sources.panel import dense_panel

    df = entry.queries()["fac_price_volume_features"](spark, sf)
    assert_same(df, connect(sf), entry.oracle_sql()["fac_price_volume_features"])
    made = df.toPandas()
    panel = dense_panel(spark, sf, ["close", "open", "high", "low", "volume"]).toPandas().sort_values("idx")
    checked = 0
    for code, own in panel.groupby("ts_code"):
        own, rows = own.reset_index(drop=True), made[made["ts_code"] == code].set_index("trade_date")
        for t in range(41, len(own), 7):
            w = own.iloc[t - 40 : t + 1].astype({n: float for n in ("close", "open", "high", "low", "volume")})
            if not (w[["close", "open", "high", "low", "volume"]] > 0).all().all():  # absent sessions and prices of 0
                continue
            close, ret = w["close"].to_numpy(), w["close"].pct_change().to_numpy()[1:]
            sign = [(x > 0) * 1 - (x < 0) * 1 for x in ret[-10:]]
            run = next((i for i, x in enumerate(reversed(sign)) if x != sign[-1]), 10) * sign[-1]
            want = {
                "r40": close[-1] / close[0] - 1, "drawdown_5": close[-1] / close[-5:].max() - 1, "drawdown_10": close[-1] / close[-10:].max() - 1, "volume_ratio_5": w["volume"].iloc[-1] / w["volume"].tail(5).mean(), "amplitude_5": ((w["high"] - w["low"]) / w["close"]).tail(5).mean(),
                "amplitude_20": ((w["high"] - w["low"]) / w["close"]).tail(20).mean(), "up_ratio_20": (ret[-20:] > 0).mean(), "streak": run, "gap_5": (w["open"].to_numpy()[-5:] / close[-6:-1] - 1).mean(),
            }
            got = rows.loc[own["trade_date"][t]]
            assert all(abs(got[n] - x) < 1e-5 for n, x in want.items()), (code, t, want, got.to_dict())
            checked += 1
    assert checked > 10


def test_account_claims_and_settlement():
    a = X.Account("100000", slippage="0", least_commission="0", commission="0", tax=[(0, "0.001"), (5, "0.0005")], participation="1")
    bar = lambda p: {"open": Decimal(p), "close": Decimal(p), "before": Decimal(10**9), "up": None, "down": None}
    a.begin(1)
    assert a.trade({"600001.SH": bar("10")}, {"600001.SH": 0.5}) == 1 and a.shares == {"600001.SH": 5000}
    assert a.trade({"600001.SH": bar("10")}, {}) == 0  # bought this session
    a.entitle("600001.SH", Decimal("0.2"), Decimal("0.1"), 2, 4, 3)
    assert a.value({}, "close") == Decimal(100000)  # not before the ex session
    a.begin(2)
    assert a.value({"600001.SH": bar("9")}, "close") == Decimal(50000) + 5000 * 9 + 1000 + 500 * 9
    a.begin(3)
    assert a.shares == {"600001.SH": 5500} and a.cash == Decimal(50000)
    a.begin(4)
    assert a.cash == Decimal(51000)
    a.begin(5)
    assert a.trade({"600001.SH": bar("10")}, {}) == 1 and a.cash == Decimal("51000") + 55000 - Decimal("27.50")
    a.shares["999999.SH"] = 100
    assert a.value({}, "close") is None and a.trade({}, {}) == 0
    assert X.lot_rule("688001.SH") == (200, 1, 100000) and X.lot_rule("300001.SZ")[2] == 300000


def test_simulated_accounts_on_a_small_market(spark):
    """One name bought on session 2 with half of a million, a dividend on its record session 3, sold on session 5."""
    rows = [("x", i, "600001.SH", w, 10.0, 10.0, 1e9, None, None) for i, w in ((1, None), (2, 0.5), (3, None), (4, None), (5, 0.0), (6, None))]
    df = spark.createDataFrame(rows, "account string, idx int, ts_code string, weight double, open double, close double, before double, up_limit double, down_limit double")
    e = spark.createDataFrame([("600001.SH", 3, 0.5, 0.0, 4, 6, 6)], "ts_code string, idx int, cash double, stock double, ex int, paid int, listed int")
    out = {r["idx"]: r for r in X.simulate_accounts(df, "account", "idx", "ts_code", entitlements=e).collect()}
    shares = 50000
    paid = round(shares * 10.01 * 1.0003, 2)
    assert abs(out[2]["cash"] - (1_000_000 - paid)) < 0.02 and out[2]["positions"] == 1
    assert abs(out[4]["nav"] - (out[3]["nav"] + 0.5 * shares)) < 1e-6
    assert out[5]["positions"] == 0 and out[6]["cash"] - out[5]["cash"] == 0.5 * shares


def test_penalty_is_chosen_on_later_sessions(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 100, float(a), float(b), float(a * 0.5 + e)) for i, (a, b, e) in enumerate(rng.normal(size=(3000, 3)))]
    df = spark.createDataFrame(rows, "idx int, a double, b double, y double")
    w, penalty, mix = M.lasso_by_time(df, "idx", ["a", "b"], "y", penalties=(0.001, 0.02, 0.3, 2.0))
    assert 0.4 < w["a"] < 0.6 and abs(w["b"]) < 0.05 and penalty in (0.001, 0.02)
    noise = df.withColumn("y", F.randn(4))
    w, penalty, _ = M.lasso_by_time(noise, "idx", ["a", "b"], "y", penalties=(0.0001, 2.0), mixes=(1.0,))
    assert penalty == 2.0 and w == {"a": 0.0, "b": 0.0}
    assert M.lasso_by_time(df.limit(0), "idx", ["a"], "y")[0] == {"a": 0.0}
