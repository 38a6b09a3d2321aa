import random

from paneloom.operators.ledger import Ledger, believed_at, bitemporal_ledger, periods


def test_ledger_keeps_what_it_supersedes():
    own = Ledger()
    own.record(0, 9, (1,), 5)
    own.record(3, 20, (2,), 7)
    own.record(0, 30, (0,), 8)
    assert sorted(own.rows(), key=lambda r: (r[0], r[3])) == [(0, 2, (1,), 5, None), (3, 9, (1,), 5, 7), (3, 9, (2,), 7, None), (10, 20, (2,), 7, None), (21, 30, (0,), 8, None)]


def test_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), s := rng.randrange(900, 1200), s + rng.randrange(-3, 200), rng.choice([None, s + rng.randrange(-30, 30)]), i, rng.choice("pqr")) for i in range(60)]
    rows += [(*r[:4], r[4] + 100, r[5]) for r in rows[:10]] + [("a", None, 5, 3, 900, "p"), (None, 1, 2, 3, 901, "p")]
    ledger = bitemporal_ledger(spark.createDataFrame(rows, "e string, s int, t int, k int, n long, v string"), "e", "s", "t", "k", "n", "v").cache()
    for clock in (1000, 1100, 10**6):
        want = {}
        for e in "ab":
            for day in range(880, 1420):
                held = [(s, -10**9 if k is None else k, n, v) for x, s, t, k, n, v in rows if x == e and s is not None and s <= day <= t and (s if k is None else k) <= clock]
                if held:
                    want[e, day] = max(held)[3]
        got = {(r[0], d): r["value"] for r in believed_at(ledger, clock).collect() for d in range(r["valid_from"], r["valid_to"] + 1)}
        assert got == want
    runs = periods(ledger.filter("recorded_to is null"), "e", "value", "valid_from", "valid_to").collect()
    assert all(a["valid_from"] <= a["valid_to"] for a in runs)


def test_empty(spark):
    none = spark.createDataFrame([], "e string, s int, t int, k int, n long, v string")
    assert bitemporal_ledger(none, "e", "s", "t", "k", "n", "v").count() == 0
