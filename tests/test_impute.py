from pyspark.sql import functions as F

from paneloom.operators.impute import Cell, fill_from_similar, fit_prototypes, held_out_error


def test_clusters_and_fallbacks(spark):
    rows = [("a", 1.0, "p", 10.0)] * 5 + [("a", 9.0, "q", 90.0)] * 5 + [("a", 1.1, "p", None), ("a", 9.1, "q", -1.0), ("b", 1.0, "p", None), ("c", 9.0, "q", 70.0), ("c", 1.0, "p", float("nan")), (None, 1.0, "p", None)]
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "i int, g string, x double, k string, y double, y_method_old string")
    real = F.when((F.col("y") > 0) & ~F.isnan("y"), F.col("y"))
    out = {r["i"]: r for r in fill_from_similar(df, "g", {"y": Cell(real, F.lit(True))}, {"x": F.col("x")}, {"k": F.col("k")}, k=2).collect()}
    assert len(out) == len(rows)
    assert (out[10]["y"], out[10]["y_method"]) == (10.0, "cluster")
    assert (out[11]["y"], out[11]["y_method"]) == (90.0, "cluster")
    assert out[12]["y_method"] == "overall" and out[12]["y"] == 10.0
    assert (out[14]["y"], out[14]["y_method"]) == (70.0, "group")
    assert out[15]["y_method"] == "overall"
    assert not out[0]["y_filled"] and out[0]["y"] == 10.0


def test_modes_and_scale(spark):
    df = spark.createDataFrame([("a", "u"), ("a", "v"), ("a", "v"), ("a", None)], "g string, c string")
    got = [r for r in fill_from_similar(df, "g", {"c": Cell(F.col("c"))}, {}, {}).collect() if r["c_filled"]]
    assert [r["c"] for r in got] == ["v"]
    df = spark.createDataFrame([("a", 11.0, 10.0), ("a", 22.0, 20.0), ("a", None, 50.0), ("a", None, None)], "g string, y double, s double")
    got = sorted(r["y"] for r in fill_from_similar(df, "g", {"y": Cell(F.col("y"), scale=F.col("s"))}, {}, {}).collect() if r["y_filled"])
    assert got[0] == 11.0 and abs(got[1] - 55.0) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([], "g string, y double, x double")
    assert fill_from_similar(df, "g", {"y": Cell(F.col("y"))}, {"x": F.col("x")}, {}).count() == 0
    assert fit_prototypes(df, ["x"], [], 3, 2).centres == [([0.0], [])]


def test_hidden_cells_are_found_by_cluster(spark):
    rows = [("a", i, float(i % 2), 10.0 if i % 2 else 90.0 + i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    r = held_out_error(df, ["i"], "g", "y", Cell(F.col("y")), {"x": F.col("x")}, {}, k=2).first()
    assert 10 < r["hidden"] < 60 and r["cluster_error"] < 0.05 < r["group_error"]
