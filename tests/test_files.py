import gzip

import pytest

from paneloom.sources import files


def test_json_that_must_fail(spark, tmp_path):
    for name, line in (("twice", '{"a": 1, "a": 2}'), ("nan", '{"a": NaN}'), ("cut", '{"a": 1')):
        (tmp_path / name).write_text('{"a": 5}\n' + line + "\n")
        with pytest.raises(Exception):
            files.read_json(spark, str(tmp_path / name), "a double").collect()
    with gzip.open(tmp_path / "fine.json.gz", "wt") as f:
        f.write('{"a": 1.5, "b": {"a": 2}}\n{"b": null}\n')
    assert [r["a"] for r in files.read_json(spark, str(tmp_path / "fine.json.gz"), "a double").collect()] == [1.5, None]


def test_facts_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "facts")
    files.append_facts(spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string"), path, "k")
    files.append_facts(spark.createDataFrame([(1, "0"), (3, "d")], "k int, v string"), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_csv_with_repeated_headers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("day,open\n1,a\nday,open\n2,b\n")
    out = files.read_csv(spark, str(tmp_path / "c.csv"), "day string, open string", repeated_header=True)
    assert [tuple(r) for r in out.collect()] == [("1", "a"), ("2", "b")]
