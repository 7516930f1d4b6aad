"""Whole-table order, running values and hot joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from polyquill.operators import post, scale, stats


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    return [(i, r.choice([None, 0.0, 0.01, 0.05, 1.0, 1.0, 1.0, round(r.random(), 3)]), f"t{r.randrange(50)}") for i in range(700)]


@pytest.fixture(autouse=True)
def parts_stay(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small tables have several parts too
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_and_running_values(spark, rows):
    df = spark.createDataFrame(rows, "id int, p double, t string").repartition(7)
    d = scale.placed(df, F.desc_nulls_last("p"), "id")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = sorted(d.collect(), key=lambda r: r.place)
    assert [r.id for r in got] == [r[0] for r in want] and [r.place for r in got] == list(range(len(rows)))
    assert len({r.part for r in got}) > 1
    up = {r.id: r.s for r in scale.running(d, "id", "s").collect()}
    down = {r.id: r.s for r in scale.running(d, "p", "s", "min", backwards=True).collect()}
    total = 0
    for r in want:
        total += r[0]
        assert up[r[0]] == total
    least = None
    for r in reversed(want):
        least = r[1] if least is None else least if r[1] is None else min(least, r[1])
        assert down[r[0]] == least
    assert scale.running(scale.placed(df.where("false"), "id"), "id", "s").count() == 0


def test_adjusted_and_neighbours_have_no_window_over_all_rows(spark, rows):
    df = spark.createDataFrame(rows, "id int, p double, t string").repartition(5)
    adjusted, around = stats.adjusted(df, "p"), post.neighbours(df, "id")
    for d in (adjusted, around):
        assert "SinglePartition" not in _plan(d)
    ps = sorted(p for _, p, _ in rows if p is not None)
    q = {p: len(ps) * p / sum(x <= p for x in ps) for p in set(ps)}
    want = {p: min(1.0, *(q[x] for x in q if x >= p)) for p in q}
    for r in adjusted.collect():
        assert r.padj is None if r.p is None else abs(r.padj - want[r.p]) < 1e-12
    got = {r.id: (r.previous, r.next) for r in around.collect()}
    assert got == {i: (i - 1 if i else None, i + 1 if i < 699 else None) for i in range(700)}


def test_hot_and_cold_keys_are_attached(spark, rows, monkeypatch):
    monkeypatch.setattr(scale, "HOT_PARTS", 30)
    df = spark.createDataFrame(rows, "id int, p double, t string")
    table = df.where("p is not null").groupBy("p").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = {r.id: r.m for r in scale.attached(df, table, ["p"], "n", 700).collect()}
    most = {}
    for i, p, _ in rows:
        most[p] = max(i, most.get(p, 0))
    assert got == {i: None if p is None else most[p] for i, p, _ in rows}


def test_counts_by_value_leave_rows_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(post, "HOT_PARTS", 3)  # the other values' counts are joined by shuffle
    values = ["a"] * 500 + [None] * 200 + ["b"] * 100 + [f"c{i % 40}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(values)), "_rows int, flag string")
    got = post.with_count(df, "flag")
    assert got.columns == ["_rows", "flag", "n"]
    assert sorted((r["_rows"], r["flag"], r["n"]) for r in got.collect()) == [(i, v, values.count(v)) for i, v in enumerate(values)]
    assert "Window" not in _plan(got)


def test_a_reads_rows_are_sorted_once(spark):
    rows = [("g", "r1", "t", 30.0, "C", 7.0), ("g", "r1", "t", 30.0, "G", 3.0), ("g", "r1", "u", 31.0, "C", 5.5), ("h", "r1", "t", 30.0, "C", 1.0), (None, "r2", None, -0.0, "G", None), (None, "r2", None, 0.0, "C", 2.0)]
    df = spark.createDataFrame(rows, "group string, readname string, transcript string, polya_length double, prediction string, est_nonA_pos double")
    found = post.spread_residues(df, values=["C", "G"])
    assert found.columns == ["group", "readname", "transcript", "polya_length", "prediction_C", "prediction_G", "nonA_residues"]
    plan = _plan(found)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted([("g", "r1", "t", 30.0, 1, 1, "G3:C5.5:C7"), ("g", "r1", "u", 31.0, 1, 0, "G3:C5.5:C7"), ("h", "r1", "t", 30.0, 1, 0, "C1"), (None, "r2", None, 0.0, 1, 1, "C2")], key=str)
    assert plan.count("Sort [") == 1 and "SortAggregate" not in plan
