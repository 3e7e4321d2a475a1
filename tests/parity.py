"""Comparison of a query with its SQL on the test tables."""

from __future__ import annotations

import glob
import math
import os

FOLDER = "/root/testdata/sf0.001"


def _plain(v):
    """Exact values but for floats, which are compared apart; NaN equals nothing, so no result may have any."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        assert not math.isnan(v), "NaN can't be compared"
        return f"{v:.6g}"
    return repr(v) if v is None else str(v)


def rows_of(columns, rows, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(_plain(r[i]) for i in at), tuple(r[i] for i in at if isinstance(r[i], float))) for r in rows)


def compare(mine, other):
    assert [r[0] for r in mine] == [r[0] for r in other]
    for (_, a), (_, b) in zip(mine, other):
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a, b)), (a, b)


def assert_same(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, FOLDER)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    order = sorted(df.columns)
    assert order == sorted(columns)
    compare(rows_of(df.columns, df.collect(), order), rows_of(columns, result.fetchall(), order))
