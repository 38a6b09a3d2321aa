import random

from pyspark.sql import functions as F

from paneloom.operators.spikes import leaves_range, level_candidates, rate_breaks, with_normal_ranges, with_stuck


def flagged(spark, rows):
    df = spark.createDataFrame(rows, "s string, t int, v double, b double, other string")
    df = level_candidates(df, "s", "t", "v", before=F.col("b"))
    df = with_normal_ranges(df, "s", "t", {"v": (F.col("_step"), 2.0)})
    return {(r["s"], r["t"]) for r in df.filter(F.col("_bad") | leaves_range(F.col("_off"), "v")).collect()}


def walk(seed, n=120):
    rng, v, out = random.Random(seed), 50.0, []
    for _ in range(n):
        v *= 1 + rng.gauss(0, 0.012)
        out.append(round(v, 2))
    return out


def test_spikes_and_steps(spark):
    v = walk(1)
    v[30] *= 1.4
    v[60] = v[60] / 1000
    v[61] = v[61] / 1000
    v[80] = 0.0
    v[81] = 9999.99
    v[100:] = [x * 0.6 for x in v[100:]]  # a step that lasts
    rows = [("a", t, x, None, "") for t, x in enumerate(v)] + [("a", 500, None, None, "")] + [("b", t, x, None, "") for t, x in enumerate(walk(2))]
    assert flagged(spark, rows) == {("a", t) for t in (30, 60, 61, 80, 81)}


def test_first_reading_and_nulls(spark):
    v = walk(3, 40)
    rows = [("a", t, x, None, "") for t, x in enumerate(v)]
    rows[0] = ("a", 0, v[0] * 1.6, v[0], "")
    assert flagged(spark, rows) == {("a", 0)}
    rows[0] = ("a", 0, v[0], v[0] / 1.6, "")  # a first day's gain that lasts
    assert flagged(spark, rows) == set()
    assert flagged(spark, [(None, 1, None, None, ""), ("a", 1, float("nan"), None, "")]) == {("a", 1)}


def test_stuck_runs(spark):
    values = [1.0, 2.0, 2.0, 2.0, 2.0, 2.0, 3.0, 3.0, 3.0, 3.0, None, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 5.0]
    moving = [True] * 14 + [False] + [True] * 3
    df = spark.createDataFrame([("a", i, v, m) for i, (v, m) in enumerate(zip(values, moving))], "s string, t int, v double, m boolean")
    out = with_stuck(df, "s", "t", ["v"], F.col("m"))
    assert {r["t"] for r in out.filter("_stuck_v").collect()} == {2, 3, 4, 5}


def test_rates(spark):
    close = walk(4, 100)
    rows = []
    for t, c in enumerate(close):
        b = close[t - 1] if t else c
        rows.append(["a", t, c, b, round(c - b, 2), round((c / b - 1) * 100, 4), False])
    rows[20][5] = 45.0
    rows[30][5] = -100.0
    rows[40][5] = 9999.0
    rows[50][5] = None
    df = spark.createDataFrame([tuple(r) for r in rows], "s string, t int, c double, b double, ch double, r double, bad boolean")
    df = with_normal_ranges(df, "s", "t", {"r": (F.when(F.abs("r") < 9000, F.col("r")), 3.0)})
    assert {r["t"] for r in rate_breaks(df, "s", "t", "r", "c", "bad", "b", "ch").filter("_rate_bad").collect()} == {20, 30, 40}
