"""A query's rows against DuckDB's over the same files, exactly."""

import glob
import os
from collections import Counter

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
    return con


def rows(table, columns):
    def one(v):
        if v is None or v != v:
            return None
        return repr(v) if isinstance(v, float) else str(v)

    return Counter(zip(*([one(v) for v in table.column(c).to_pylist()] for c in columns))) if table.num_rows else Counter()


def assert_same(df, con, sql):
    got, want = df.toArrow(), con.sql(sql).to_arrow_table()
    columns = sorted(want.column_names)
    assert columns == sorted(got.column_names)
    a, b = rows(got, columns), rows(want, columns)
    assert not a - b and not b - a, (list((a - b).items())[:3], list((b - a).items())[:3])
