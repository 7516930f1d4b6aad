"""The trie against plain search, and the scores against a model of dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from polyquill.llm import lmscore
from polyquill.llm.eftrie import DISCOUNT, EliasFano, Trie


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (50, 60), (5000, 10**6), (3000, 2**50), (70000, 10**7)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    v = np.unique(r.integers(0, top, n))
    e = EliasFano(EliasFano.encode(v))
    assert (e.get(np.arange(len(v))) == v).all()
    q = np.concatenate([r.integers(0, 2 * top, 500), v[:300], v[-2:]])
    i, hit = e.find(q)
    assert (i == np.searchsorted(v, q)).all() and (hit == np.isin(q, v)).all()


def brute(rows):
    texts = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c1, c2, c3 = Counter(), defaultdict(Counter), defaultdict(Counter)
    for t, h in zip(texts, held):
        if not h:
            c1.update(t)
    known = lambda w: w if c1[w] else "\0"

    def grams(t):
        k = ["\1", "\1", *(known(w) for w in t)]
        return zip(k, k[1:], k[2:], t)

    for t, h in zip(texts, held):
        for u, v, w, _ in grams(t) if not h else ():
            c2[v][w] += 1
            c3[u, v][w] += 1
    n, kinds = sum(c1.values()), len(c1)
    for t, h in zip(texts, held):
        base = score = 0
        for u, v, w, raw in grams(t):
            p = (c1[raw] + 0.5) / (n + 0.5 * (kinds + 1)) if n else 1
            base += math.log10(p)
            for c in (c2[v], c3[u, v]):
                if c:
                    total = sum(c.values())
                    p = max(c[w] - DISCOUNT, 0) / total + DISCOUNT * len(c) / total * p
            score += math.log10(p)
        yield h, len(t), sum(c1[w] > 0 for w in t), n, base, score


def test_scores(spark):
    r = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{int(x)}" for x in r.zipf(1.4, n) % 300)
    rows = [(i, text(int(r.integers(1, 80)))) for i in range(150)] + [(None, text(20)), (900, None), (901, ""), (902, " \n "), (903, "New words HERE"), (903, "New words HERE"), (904, text(4000)), (905, "the " * 3000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, shard string")
    want = sorted(brute(rows))
    for shard in (1_500_000, 1000):  # one shard, then many
        got = sorted((x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in lmscore.score(docs, shard_tokens=shard).collect())
        assert [g[:4] for g in got] == [w[:4] for w in want]
        np.testing.assert_allclose([g[4] for g in got], [w[4] for w in want])
        np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=4e-3, atol=1e-6)
    none = spark.createDataFrame([], docs.schema)
    assert lmscore.score(none).count() == 0
    held = docs.where("crc32(cast(doc_id as string)) % 5 = 1")
    assert all(x.score == x.base_score == 0 for x in lmscore.score(held).collect())


def test_hot_words_are_divided():
    """Classes of a frequent word are the same, and their probabilities whole, however many shards there are."""
    from polyquill.llm.lmscore import _answer_trigrams, _pack, _Slice, _unpack

    r = np.random.default_rng(1)
    token, size = r.integers(0, 9, 4000).astype(np.uint16), np.full(40, 100, np.uint32)
    blob = _pack(np.arange(40), np.zeros(40, bool), np.arange(40) % 5 == 1, size, np.arange(9, dtype=np.uint16), token)
    out = []
    for shards, times in ((1, 40_000), (7, 40_000), (7, 1)):
        c = np.bincount(token, minlength=9) * times
        s = _Slice(blob, [_pack(c, np.arange(2, 11, dtype=np.uint32))], shards, 4000 * times, 9)
        asked = list(s.questions())
        answers = [b.column("blob")[0].as_py() for k, q in asked for b in _answer_trigrams(k, [(0, q)])]
        assert sum(_unpack(q)[6].sum() for _, q in asked) == 3200 and (_unpack(asked[0][1])[1].max() > 0) == (times > 1)
        out.append(s.results(answers)[3])
    np.testing.assert_allclose(out[0], out[1])
    assert not np.allclose(out[0], out[2])


@pytest.mark.parametrize("shard", [1_500_000, 1000])
def test_divided_words_keep_the_model(spark, shard):
    """P(w | v) of a word over class_tokens is that of the whole corpus."""
    r = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.4, int(r.integers(1, 80))) % 300)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    want = sorted(brute(rows))
    got = sorted((x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in lmscore.score(docs, shard_tokens=shard, class_tokens=40).collect())
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=4e-3, atol=1e-6)


def test_divided_words_over_slices():
    """Slices that lack some of a divided word's pairs and classes get the scores they get when it isn't divided."""
    from polyquill.llm.lmscore import _answer_trigrams, _pack, _Slice

    r, n = np.random.default_rng(2), 60
    tokens = [r.zipf(1.3, 900) % n for _ in range(3)] + [np.array([0, 3, 0])]
    sizes = [[90] * 10] * 3 + [[3]]
    c = np.bincount(np.concatenate(tokens), minlength=n)
    out = []
    for most in (10**9, 30):
        blobs = [_pack(np.arange(len(z)), np.zeros(len(z), bool), np.zeros(len(z), bool), np.array(z, np.uint32), np.arange(n, dtype=np.uint16), t.astype(np.uint16)) for t, z in zip(tokens, sizes)]
        slices = [_Slice(b, [_pack(c, np.arange(2, n + 2, dtype=np.uint32))], 5, int(c.sum()), n, most) for b in blobs]
        asked = sorted((k, i, q) for i, s in enumerate(slices) for k, q in s.questions())
        answers = [(i, b) for k in range(5) for batch in _answer_trigrams(k, [(i, q) for j, i, q in asked if j == k]) for i, b in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist())]
        out.append(np.concatenate([s.results([b for j, b in answers if i == j])[3] for i, s in enumerate(slices)]))
    np.testing.assert_allclose(out[1], out[0], rtol=4e-3)


def test_file(tmp_path):
    one = np.ones(1, np.int64)
    (tmp_path / "t").write_bytes(Trie.build(one, one, one, one * 0.5, one * 0, one, one)[:])
    assert Trie.open(str(tmp_path / "t")).score(one, one, one, one * 0.5)[0] > 0.5
