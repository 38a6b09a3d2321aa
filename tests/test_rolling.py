import random

import pytest

from paneloom.operators.rolling import trailing_totals


@pytest.mark.parametrize("tile,block", [(32, 1), (128, 64)])
def test_against_brute_force(spark, tile, block):
    rng = random.Random(2)
    values = {(e, t): rng.choice([None, float("nan"), float(rng.randrange(50))]) for e in "abc" for t in range(40, 200) if rng.random() < 0.3}
    spans = {"a": (60, 170), "b": (41, 41), "d": (90, 100)}
    rows = spark.createDataFrame([(e, t, v, "x") for (e, t), v in values.items()] + [(None, 50, 1.0, "x"), ("a", None, 1.0, "x")], "e string, t int, v double, day_no string")
    got = trailing_totals(rows, spark.createDataFrame([(k, *v) for k, v in spans.items()] + [(None, 1, 2)], "e string, first int, last int"), "e", "t", ["v"], [7, 30], tile, block)
    clean = lambda v: v if v is not None and v == v else 0.0
    want = {}
    for e, (a, b) in spans.items():
        for t in range(a, b + 1):
            want[e, t] = (t - a + 1, *(sum(clean(values.get((e, u))) for u in range(t - n + 1, t + 1)) for n in (7, 30)))
    assert {(r["e"], r["t"]): (r["day_no"], r["v_7"], r["v_30"]) for r in got.collect()} == want


def test_empty(spark):
    rows = spark.createDataFrame([], "e string, t int, v double")
    spans = spark.createDataFrame([("a", 3, 5)], "e string, first int, last int")
    assert [r["v_7"] for r in trailing_totals(rows, spans, "e", "t", ["v"], [7]).collect()] == [0.0, 0.0, 0.0]
    assert trailing_totals(rows, spans.limit(0), "e", "t", ["v"], [7]).count() == 0
    with pytest.raises(ValueError):
        trailing_totals(rows, spans, "e", "t", ["v"], [40], tile=8)
