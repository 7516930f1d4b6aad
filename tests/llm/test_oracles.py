"""Queries whose whole result SQL can express give the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from polyquill.llm import oracles, queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_rows(name, duck, spark):
    df = queries.queries()[name](spark, DIR)
    res = duck.execute(oracles.SQL[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(str(dict(zip(columns, r))[c]) for c in order) for r in res.fetchall())
    assert sorted(tuple(str(r[c]) for c in order) for r in df.collect()) == want
