"""Signal kernels against plain versions of the reference's steps."""

from collections import Counter
from statistics import mean, stdev

import numpy as np
import pytest

from polyquill.functions import signal as K


def ranked(x, n):
    return [v for v, _ in sorted(Counter(float(v) for v in x).items(), key=lambda p: (-p[1], p[0]))][:n]


def plain(x, lag=100, threshold=3.5, seed=123):
    x = [float(v) for v in x]
    often = ranked(x, 20)
    pool = often + [None] * (20 - len(often)) + x[:10] + [None] * (10 - len(x[:10]))
    kept = [pool[i] for i in np.random.default_rng(seed).choice(30, lag)] + x
    out = []
    for i in range(lag, len(kept)):
        seen = [v for v in kept[max(0, i - 1 - lag) : i] if v is not None]
        over = kept[i] - mean(seen)
        far = abs(over) > threshold * stdev(seen)
        out.append((1 if over > 0 else -1) if far else 0)
        kept[i] = kept[i - 1] if far else kept[i]
    out[:5] = [0] * len(out[:5])
    return [out[i - 1] if 0 < i < len(out) - 1 and not out[i] and out[i - 1] == out[i + 1] else out[i] for i in range(len(out))]


@pytest.mark.parametrize("seed", range(8))
def test_pseudomoves(seed):
    r = np.random.default_rng(seed)
    x = np.rint(r.normal(650, 12, 300)).astype(int)
    x[:8] += 300 * (seed % 2)
    x[40:52] += 200
    x[150:160] -= 180
    x[200:260] = r.choice([640, 650, 660], 60)
    assert K.pseudomoves(x).tolist() == plain(x)


def _tails(n, seed):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = np.rint(r.normal(650, r.choice([0, 3, 12, 40]), r.choice([1, 2, 5, 9, 40, 120, 300, 600]))).astype(int)
        for _ in range(r.integers(0, 4)):
            at, wide = r.integers(0, len(x)), r.integers(1, 30)
            x[at : at + wide] += r.choice([-200, 150, 400])
        out.append(x)
    return [*out, np.zeros(0, int)]


def test_many_at_once_are_as_one_by_one_and_faster():
    import time

    tails = _tails(1000, 1)
    began = time.perf_counter()
    got = K.pseudomoves_of(tails)
    took = time.perf_counter() - began
    assert all(a.tolist() == K.pseudomoves(x).tolist() for a, x in zip(got, tails))
    began = time.perf_counter()
    for x in tails[:60]:
        K.pseudomoves(x)
    assert (time.perf_counter() - began) / 60 * 1000 > 10 * took
    draws = np.arange(100) % 30
    assert [m.tolist() for m in K.pseudomoves_of(tails[:20], draws=draws)] == [m.tolist() for x in tails[:20] for m in K.pseudomoves_of([x], draws=draws)]


def test_many_fields_at_once():
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(500, 900, (20, 100)), np.full((1, 100), 7)])
    assert np.array_equal(K.gaf_of(x), np.stack([K.stacked_gaf(v) for v in x]))


def test_the_baseline_starts_at_frequent_values_and_the_first_five_moves_are_zero():
    x = np.array([*range(500, 522)] * 5 + [900 + 7 * i for i in range(40)] + [*range(500, 522)] * 5)
    got = K.pseudomoves(x)
    assert got.tolist() == plain(x) and (got[110:130] == 1).all()
    x[:20] = 5000
    assert not K.pseudomoves(x)[:5].any()
    assert not K.pseudomoves(np.full(50, 7)).any() and len(K.pseudomoves([])) == 0


def test_padding_is_drawn_from_frequent_values():
    x = np.array([5, 5, 5, 4, 4, 4, 3, 3, 2, 2, 1, 1, 9, 8, 7] + [6] * 4 + [99, 98])
    assert K.most_frequent(x, 5).tolist() == ranked(x, 5) == [6, 4, 5, 1, 2]
    (first, chunk), = K.chunks(x, np.array([0] * 4 + [1] * 6 + [0] * 11))
    inside = (np.arange(first, first + 100) >= 1) & (np.arange(first, first + 100) <= len(x))
    assert (chunk[inside] == x).all() and set(chunk[~inside]) == {6, 4, 5, 1, 2}
    last = K.overlapping(x, 20, 0)[-1]
    assert last[0] == 98 and len(last) == 20 and set(last[1:]) <= set(ranked(x, 10))


def test_whole_quantiles_are_not_cut_to_the_number_below():
    import duckdb
    import pandas as pd

    x = [136, 166, 91, 1285, 340, 721, 0, 32, 5, 604, 222, 407, 610, 47, 526, 1859, 516, 553, 5, 547, 1049, 241, 341, 353, 1249, 119, 748, 1460, 362, 325, 18, 685, 658, 11, 214, 982, 173, 428, 774, 1199, 1804]
    assert K.winsorize(x)[15] == 1848  # the quantile is 1804 + 0.8 * 55
    r = np.random.default_rng(7)
    con = duckdb.connect()
    con.execute("create table v (g int, v double)")
    signals = [np.round(r.exponential(50, n), 2) * (10 if n % 2 else 1) for n in r.integers(1, 110, 3000)]
    signals += [np.full(n, 1804.0) for n in range(1, 100)]
    values, numbers = np.concatenate(signals), np.repeat(np.arange(len(signals)), [len(s) for s in signals])
    con.register("given", pd.DataFrame({"g": numbers, "v": values}))
    want = con.execute("select g, trunc(quantile_cont(v, 0.005)), trunc(quantile_cont(v, 0.995)) from given group by 1 order by 1").fetchall()
    assert [(i, np.trunc(K.quantile(np.sort(s), 0.005)), np.trunc(K.quantile(np.sort(s), 0.995))) for i, s in enumerate(signals)] == want


def test_fields_of_a_batch_leave_in_portions(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    signals = [r.normal(size=64).astype(np.float32) for _ in range(300)] + [np.zeros(0, np.float32), None, r.normal(size=700), r.normal(size=64)]
    for rows, method in ((K.gaf_rows, "s"), (K.gaf_d_rows, "d")):
        parts = list(rows.func(iter([pd.Series(signals, dtype=object)])))
        assert sum(map(len, parts)) == len(signals)
        assert all(len(p) == 1 or sum(0 if v is None else len(v) for v in p) <= K.FIELD_ENTRIES for p in parts)
        df = spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in enumerate(signals)], "id long, x array<double>").coalesce(1)
        got = {i: g for i, g in df.select("id", rows("x").alias("g")).collect()}
        for i, x in enumerate(signals):
            assert got[i] == (None if x is None else K.gaf(x, method).ravel().tolist() if len(x) else [])
    assert not df.where("id < 0").select(K.gaf_rows(F.col("x"))).collect()
