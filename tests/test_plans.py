import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paneloom.plans import forge, structure, typed
from paneloom.plans.formula import FormulaError, crosses, parse
from paneloom.plans.nodes import field, lag, mean
from paneloom.plans.spark_backend import evaluate, schedule

C = {"field": "close"}


def op(name, *args, window=None):
    return {"op": name, "args": list(args)} | ({"window": window} if window else {})


@pytest.mark.parametrize("tree", [
    op("log", C), op("add", C, {"field": "volume"}), op("div", C, C), op("div", C, op("delta", C, window=1)), op("mean", op("rank", C), window=5), op("mean", C), op("rank", C, window=3),
    op("std", C, window=1), op("lag", C, window=253), {"field": "nothing"}, op("foo", C), {"op": "neg"}, "close",
])
def test_type_rules_reject(tree):
    with pytest.raises(typed.ExpressionError):
        typed.infer(tree)


def test_budgets_and_lookback():
    deep = C
    for _ in range(12):
        deep = op("neg", deep)
    with pytest.raises(typed.ExpressionError):
        typed.compile_typed(deep)
    assert typed.compile_typed(op("rank", op("return", C, window=20))).lookback == 20
    assert mean(lag(field("close"), 3), 5).lookback == 7
    assert "log" not in typed.allowed_operators(typed.infer(C))
    for tree in typed.templates().values():
        typed.compile_typed(tree)


@pytest.mark.parametrize("text", ["close +", "foo(close)", "nothing", "rank(close", "close $ 2", "", "__import__('os')", "close.rolling(5).apply(1)", "rank()"])
def test_formulas_reject(text):
    with pytest.raises((FormulaError, IndexError)):
        parse(text)


def test_precedence_and_forms():
    assert parse("close - open * 2") == parse("sub(close, mul(open, 2))")
    assert parse("-close ** 2") == parse("neg(close ** 2)")
    assert parse("close.rolling(5).mean()") == parse("ma(close, 5)")
    assert parse("x = close / open\nx - 1") == parse("close / open - 1")
    assert crosses(parse("rank(close)")) and not crosses(parse("ma(close, 3)"))


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_random_trees_build_and_simplify(seed):
    tree = forge.grow(random.Random(seed), 4)
    node = forge.build(tree)
    forge.build(forge.simplify(tree))
    steps = schedule([node])
    made = [n for _, nodes in steps for n in nodes]
    assert len(made) == len(set(made))
    done: set = set()
    for _, nodes in steps:
        for n in nodes:
            assert all(m in done or m not in made for a in n.args for m in a.walk())
        done |= set(nodes)


def test_structure():
    a, b = parse("ma(close, 5) / ma(close, 20)"), parse("ma(close, 10) / ma(close, 60)")
    assert structure.skeleton(a) == structure.skeleton(b) and structure.similarity(a, b) == 1.0
    kinds = {k for k, _ in structure.edits(a, ["open", "close"])}
    assert kinds == {"field", "window", "operator", "wrap", "unwrap"}
    assert structure.crossover(a, parse("rank(volume)"), random.Random(1)).size > 0


def panel(spark, values, instrument="a"):
    rows = [(instrument, i, str(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ts_code string, idx int, trade_date string, close double")


def run(spark, df, node):
    return {(r["ts_code"], r["idx"]): r["y"] for r in evaluate(df, {"y": node}, group=None).collect()}


def test_golden_cases(spark):
    df = spark.createDataFrame([(k, 0, "0", v) for k, v in (("a", 2.0), ("b", 2.0), ("c", 4.0), ("d", None))], "ts_code string, idx int, trade_date string, close double")
    got = run(spark, df, typed.compile_typed(op("rank", C)))
    assert got[("a", 0)] == pytest.approx(1 / 3) and got[("b", 0)] == pytest.approx(1 / 3) and got[("c", 0)] == pytest.approx(5 / 6) and got[("d", 0)] is None
    assert run(spark, df.filter("ts_code = 'a'"), typed.compile_typed(op("rank", C)))[("a", 0)] is None
    assert all(v is None for v in run(spark, df, parse("close / (close - close)")).values())


def test_future_does_not_change_the_past(spark):
    values = [10 + (i * 7 % 5) + i * 0.1 for i in range(40)]
    node = parse("ts_std(returns, 5) + ema(close, 4) - ts_rank(close, 6) + ts_decay_linear(close, 3)")
    a = run(spark, panel(spark, values), node)
    b = run(spark, panel(spark, values[:30] + [v * 3 for v in values[30:]]), node)
    assert all(a[k] == b[k] for k in a if k[1] < 30)


def test_barrier(spark):
    df = panel(spark, [1.0, 2.0, 4.0, 8.0]).selectExpr("*", "2 as barrier")
    got = run(spark, df, typed.compile_typed(op("return", C, window=1), barrier=True))
    assert [got[("a", i)] for i in range(4)] == [None, None, None, 1.0]


def test_exponential_mean_against_recursion(spark):
    import pandas as pd

    values = [float((i * 37) % 11) if i % 7 else None for i in range(400)]
    for adjust in (True, False):
        want = pd.Series(values[1:] if not adjust else values, dtype=float).ewm(span=5, adjust=adjust).mean().tolist()
        if adjust:
            got = run(spark, panel(spark, values), parse("ema(close, 5)"))
            assert all(got[("a", i)] == pytest.approx(w, rel=1e-9) for i, w in enumerate(want) if w == w)
        else:
            full = [float((i * 37) % 11) for i in range(400)]
            want = pd.Series(full).ewm(span=5, adjust=False).mean().tolist()
            from paneloom.plans.nodes import ema

            got = run(spark, panel(spark, full), ema(field("close"), 5, adjust=False))
            assert all(got[("a", i)] == pytest.approx(w, rel=1e-9) for i, w in enumerate(want))


def test_one_shuffle_for_a_batch_of_time_windows(spark):
    nodes = {"a": mean(field("close"), 5), "b": lag(field("close"), 3), "c": mean(mean(field("close"), 3), 4)}
    plan = evaluate(panel(spark, [1.0, 2.0]), nodes, group=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
