import random

from pyspark.sql import functions as F

from paneloom.operators.stabbing import greatest_in_force
from paneloom.operators.versions import InForce, attributes_at


def test_greatest_in_force_against_brute_force(spark):
    rng = random.Random(3)
    intervals = [(rng.choice("ab"), a := rng.randrange(0, 300), a + rng.randrange(-3, 90), rng.randrange(1000)) for _ in range(150)]
    points = [(e, t) for e in "abc" for t in range(0, 420, 3)]
    want = {}
    for e, t in points:
        held = [r for k, a, b, r in intervals if k == e and a <= t <= b]
        if held:
            want[e, t] = max(held)
    got = greatest_in_force(spark.createDataFrame(points, "e string, t int"), spark.createDataFrame(intervals, "e string, a int, b int, r int"), "e", "t", "a", "b", "r")
    assert {(r["e"], r["t"]): r["r"] for r in got.collect()} == want


def test_attributes_as_known(spark):
    rng = random.Random(4)
    none = lambda v, p: None if rng.random() < p else v
    rows = [(i, rng.choice("ab"), none(s := rng.randrange(100, 200), 0.1), none(s + rng.randrange(-5, 60), 0.3), none(s + rng.randrange(-20, 40), 0.2)) for i in range(80)]
    events = [(i, rng.choice(["a", "b", "c", None]), none(rng.randrange(90, 260), 0.1)) for i in range(200)] * 2
    want = []
    for i, e, t in events:
        held = [(s, -1 if k is None else k, n) for n, x, s, b, k in rows if x == e and t is not None and s is not None and s <= t and (b is None or b >= t) and (k is None or k <= t)]
        want.append((i, max(held)[2] if held else None))
    attrs = spark.createDataFrame(rows, "n int, e string, s int, b int, k int")
    got = attributes_at(spark.createDataFrame(events, "i int, e string, t int"), attrs, "e", "t", F.col("s"), F.col("b"), F.col("k"), ["n"], [F.col("n")])
    order = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert sorted([(r["i"], r["attrs"]["n"] if r["attrs"] else None) for r in got.collect()], key=order) == sorted(want, key=order)


def test_empty_tables(spark):
    attrs = spark.createDataFrame([], "n int, e string, s int, b int, k int")
    events = spark.createDataFrame([(1, "a", 5)], "i int, e string, t int")
    got = attributes_at(events, attrs, "e", "t", F.col("s"), F.col("b"), F.col("k"), ["n"], [F.col("n")]).collect()
    assert len(got) == 1 and got[0]["attrs"] is None
    assert attributes_at(events.limit(0), attrs, "e", "t", F.col("s"), F.col("b"), F.col("k"), ["n"], [F.col("n")]).count() == 0


def test_one_shuffle_and_state_over_batches(spark):
    rng = random.Random(5)
    none = lambda v, p: None if rng.random() < p else v
    rows = [(none(i, 0.1), rng.choice("abcd"), s := rng.randrange(100, 140), none(s + rng.randrange(-5, 90), 0.2), none(s + rng.randrange(-20, 40), 0.3), f"w{i}") for i in range(400)]
    events = [(i, rng.choice(["a", "b", "c", "e", None]), none(rng.randrange(90, 260), 0.1)) for i in range(700)]
    want = {}
    for i, e, t in events:
        held = [(s, -1 if k is None else k, -1 if n is None else n, w) for n, x, s, b, k, w in rows if x == e and t is not None and s <= t and (b is None or b >= t) and (k is None or k <= t)]
        top = max(held)[:3] if held else None
        want[i] = {r[3] for r in held if r[:3] == top} if held else {None}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        attrs = spark.createDataFrame(rows, "n int, e string, s int, b int, k int, w string")
        df = attributes_at(spark.createDataFrame(events, "i int, e string, t int"), attrs, "e", "t", F.col("s"), F.col("b"), F.col("k"), ["w"], [F.col("n")])
        got = {r["i"]: r["attrs"]["w"] if r["attrs"] else None for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys() and all(got[i] in want[i] for i in want)
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("RepartitionByExpression") + plan.count("Exchange hashpartitioning") <= 2 and "Generate" not in plan and "Join" not in plan


def test_rows_that_never_count_are_not_kept():
    state = InForce()
    for i in range(1000):
        state.insert((i, i, i), 5000 - i % 7, i)
    assert len(state.at) <= 7 and state.greatest(10) == 999
