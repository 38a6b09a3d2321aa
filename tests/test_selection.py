import itertools
import math

import numpy as np

from paneloom.operators import selection as C
from paneloom.queries.research import ablated
from paneloom.plans.nodes import field, fn, mean


def made(seed, n=4000, k=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    x[:, 1] = x[:, 0] * 0.95 + x[:, 1] * 0.3
    y = x[:, 0] * 0.3 - x[:, 3] * 0.2 + rng.normal(size=n)
    return np.corrcoef(np.column_stack([x, y]).T), n


def test_beam_finds_the_best_set_of_all():
    m, n = made(1)
    a, b = m[:-1, :-1], m[:-1, -1]

    def bic(own):
        own = list(own)
        return n * math.log(1 - b[own] @ np.linalg.solve(a[np.ix_(own, own)], b[own])) + len(own) * math.log(n)

    best = min((own for k in range(1, 6) for own in itertools.combinations(range(6), k)), key=bic)
    found, value = C.beam_stack(a, b, n)
    assert tuple(found) == best and abs(value - bic(best)) < 1e-3
    assert C.beam_stack(np.eye(3), np.zeros(3), 1000) == ([], 0.0)


def test_three_stages():
    corr = np.array([[1, 0.9, 0.1, 0], [0.9, 1, 0.1, 0], [0.1, 0.1, 1, 0], [0, 0, 0, 1.0]])
    icir = {"a": 0.3, "b": 0.4, "c": 0.2, "d": 0.05}
    windows = {"a": [1, 1], "b": [1, 1, 1], "c": [1, -1, -1], "d": [1]}
    assert C.three_stage_screen(icir, corr, windows) == {"a": "cluster", "b": "kept", "c": "unstable", "d": "weak"}
    assert C.three_stage_screen({}, np.eye(0), {}) == {}


def test_ward_by_brute_force():
    """Two far groups of points on a line fall apart, whatever their order."""
    at = np.array([0.0, 5.0, 0.1, 5.1, 0.2])
    assert sorted(C.merged_clusters(np.abs(at[:, None] - at), 1.0)) == [[0, 2, 4], [1, 3]]
    assert len(C.merged_clusters(np.abs(at[:, None] - at), 100.0)) == 1


def test_six_stages(spark):
    rng = np.random.default_rng(2)
    level = {"pool": 0.05, "copy": 0.04, "good": 0.06, "twin": 0.07, "noise": 0.0, "few": 0.2, "near": 0.05, "plain": 0.012}
    rows = [(f, i, float(v + rng.normal(0, 0.05 if f != "plain" else 0.2))) for f, v in level.items() for i in range(10 if f == "few" else 200)]
    names = list(level)
    corr = np.eye(len(names))
    for a, b, v in (("copy", "pool", 0.9), ("near", "good", 0.8)):
        i, j = names.index(a), names.index(b)
        corr[i, j] = corr[j, i] = v
    skeletons = {n: n for n in names} | {"twin": "good"}
    out = {n: s for n, (s, _, _) in C.validated(spark.createDataFrame(rows, "factor string, idx int, ic double"), corr, names, ["pool"], skeletons).items()}
    assert out == {"copy": "library", "good": "passed", "twin": "duplicate", "noise": "fast", "few": "fast", "near": "replaced", "plain": out["plain"]}
    assert out["plain"] in ("fast", "significance")
    assert C.validated(spark.createDataFrame([], "factor string, idx int, ic double"), np.eye(1), ["x"], [], {"x": "x"}) == {"x": ("fast", 0.0, 1.0)}


def test_ablation_touches_one_field():
    node = mean(field("a"), 3) + field("b")
    assert ablated(node, "a") == mean(fn("xmean", field("a")), 3) + field("b") and ablated(node, "z") == node
