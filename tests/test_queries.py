import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from sparkloom.queries import QUERIES, SQL


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x.item() if isinstance(x, np.generic) else x


#: Queries whose rows come in an order.
ORDERED = ("sort_asc", "sort_desc", "sort_total", "merge_", "top_n_asc", "top_n_desc", "plan_remote_merge", "nations_per_region", "declared_plan")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for f in os.listdir(folder):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, duck, name):
    df = QUERIES[name](spark, tables)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [df.columns.index(c) for c in want.columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got, want = [tuple(plain(r[i]) for i in at) for r in got], [plain(r) for r in want.fetchall()]
    if name.startswith(ORDERED):
        assert got == want
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) == set(QUERIES)
