import random

import pytest

from paneloom.operators.copies import difference


def brute(left, right, tol):
    """left, right: {key: value}."""
    out = set()
    for k in {*left, *right}:
        if k not in right:
            out.add((*k, "v", "only_left"))
        elif k not in left:
            out.add((*k, "v", "only_right"))
        elif (left[k] is None) != (right[k] is None) or (left[k] is not None and abs(left[k] - right[k]) > tol):
            out.add((*k, "v", "value"))
    return out


def frame(spark, d, extra=False):
    rows = [(*k, v, 7) for k, v in d.items()]
    return spark.createDataFrame(rows, "a string, b int, v double, diff int" if extra else "a string, b int, v double, other int")


@pytest.mark.parametrize("leaf_rows", [2, 64])
def test_against_brute_force(spark, leaf_rows):
    rng = random.Random(5)
    left = {(rng.choice("xxxy"), i): rng.choice([None, 1.0, 2.0, 3.25]) for i in range(300)}
    right = {k: (v if rng.random() < 0.9 else rng.choice([None, 2.006, v])) for k, v in left.items() if rng.random() < 0.95} | {("z", 1): 4.0, (None, 2): 1.0}
    left[(None, 2)] = 1.0
    left[(None, 3)] = 1.0
    got = {tuple(r) for r in difference(frame(spark, left), frame(spark, right, True), ["a", "b"], {"v": 0.005}, 300, leaf_rows).collect()}
    assert got == brute(left, right, 0.005)


def test_empty_sides_and_noise(spark):
    one = frame(spark, {("x", 1): 1.0, ("x", 2): float("nan")})
    none = one.limit(0)
    assert {r["diff"] for r in difference(one, none, ["a", "b"], {"v": 0.01}, 2).collect()} == {"only_left"}
    assert difference(none, none, ["a", "b"], {"v": 0.01}, 0).count() == 0
    noisy = frame(spark, {("x", 1): 1.0 + 1e-9, ("x", 2): None})
    assert difference(one, noisy, ["a", "b"], {"v": 0.01}, 2).count() == 0


def test_repeated_rows_count_once(spark):
    one = frame(spark, {("x", 1): 1.0})
    assert difference(one.union(one), one, ["a", "b"], {"v": 0.01}, 2).count() == 0
