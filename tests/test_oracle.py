"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from polyquill.plans import driver

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(columns), sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_same_rows(name, duck, spark):
    df = driver.queries()[name](spark, DIR)
    got = _rows(df.columns, df.collect())
    res = duck.execute(driver.oracle_sql()[name])
    assert got == _rows([d[0] for d in res.description], res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns
