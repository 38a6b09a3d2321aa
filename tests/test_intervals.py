from hypothesis import given, settings
from hypothesis import strategies as st

from paneloom.functions.columns import LAST_DAY
from paneloom.operators.intervals import IntervalMap, coverage

pairs = st.lists(st.tuples(st.integers(0, 60), st.integers(-3, 20)), max_size=30)


@given(pairs)
@settings(max_examples=200, deadline=None)
def test_map_equals_set_of_days(items):
    own, days = IntervalMap(), set()
    for a, n in items:
        own.insert(a, a + n)
        days |= set(range(a, a + n + 1))
    assert {d for a, b in zip(own.first, own.last) for d in range(a, b + 1)} == days
    assert all(b + 1 < a for b, a in zip(own.last, own.first[1:]))
    gaps = {d for a, b in own.gaps(0, 90) for d in range(a, b + 1)}
    assert gaps == set(range(91)) - days


def test_coverage(spark):
    rows = [("a", 5, 9), ("a", 10, 12), ("a", 20, None), ("a", 30, 25), ("a", None, 3), (None, 1, 2), ("x", 1, 2), ("a", 5, 9)]
    spans = [("a", 3, 40), ("b", 1, 4), ("c", None, 9), ("d", 9, 3), (None, 1, 1)]
    got = coverage(spark.createDataFrame(rows, "e string, s int, t int"), spark.createDataFrame(spans, "e string, lo int, hi int"), "e", "s", "t", "lo", "hi")
    assert {tuple(r) for r in got.collect()} == {("a", "covered", 5, 12), ("a", "covered", 20, 40), ("a", "gap", 3, 4), ("a", "gap", 13, 19), ("b", "gap", 1, 4)}
    empty = coverage(spark.createDataFrame([], "e string, s int, t int"), spark.createDataFrame([("a", 3, None)], "e string, lo int, hi int"), "e", "s", "t", "lo", "hi")
    assert [tuple(r) for r in empty.collect()] == [("a", "gap", 3, LAST_DAY)]
