import pytest
from pyspark.sql import functions as F

from paneloom.operators import screening as G
from paneloom.session import forget, shared_folder, written


def test_shapley_adds_up():
    values = {"a": 1.0, "b": 2.0, "ab": 5.0}
    out = G.shapley(lambda s: values.get("".join(s), 0.0), ["a", "b"])
    assert out == {"a": 2.0, "b": 3.0} and sum(out.values()) == 5.0
    with pytest.raises(ValueError):
        G.shapley(lambda s: 0.0, list("abcdef"))
    assert G.seats(3) == 1 and G.seats(100) == 8


def test_screen_and_grades(spark):
    rows = [(i, 0.05 + 0.001 * (i % 5), str(2020 + i // 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, v double, y string")
    out = G.evidence_screen(df, "i", "v", "y", replicates=50).first()
    assert out["direction"] == 1.0 and out["passed"] and out["years"] == 1.0
    grades = spark.createDataFrame([(0.7,), (0.5,), (0.3,), (0.1,)], "x double").select(G.grade(F.col("x"))).collect()
    assert [g[0] for g in grades] == ["A", "B", "C", "D"]


def test_rolling_days_sees_its_own_day(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("a", 10, 5.0)], "k string, d int, v double")
    got = sorted((r["d"], r["v"], r["mean"]) for r in G.rolling_days(df, "k", "d", "v", 9, 1).collect())
    assert got == [(1, 1.0, 2.0), (1, 3.0, 2.0), (10, 5.0, 5.0)]


def test_written_tables_are_shared_and_forgotten(spark):
    df = written(spark.range(3))
    assert df.count() == 3 and shared_folder(spark) in df.inputFiles()[0]
    forget(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.inputFiles()[0]).count()
