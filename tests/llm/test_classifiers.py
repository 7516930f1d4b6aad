"""Held-out accuracy of the trained operators, the chain's recursions against enumeration, and defined results."""

import itertools

import numpy as np
import pytest

from polyquill.llm import quality_crf, quality_rules, toxicity
from polyquill.llm.linecrf import N_FEATURES, Crf, read_lines
from polyquill.llm.textkit import Hasher

import pyarrow as pa

SF = "/root/testdata/sf0.01"


def _words(r, n, bad):
    w = ["".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(2, 9)))) for _ in range(n)]
    if bad:
        for i in r.integers(0, n, 4):
            w[i] = ["scoundrel", "vermin", "nitwit", "zzqxachlich"][int(r.integers(0, 4))] + ("" if r.random() < 0.5 else w[i])
    return " ".join(w)


def test_toxicity_of_held_out_texts(spark):
    r = np.random.default_rng(1)
    truth = [bool(r.random() < 0.15) for _ in range(900)]
    texts = [_words(r, int(r.integers(20, 90)), t) for t in truth]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (5000, None, "x"), (5000, None, "x"), (5001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth) if i % 10], "doc_id long, toxic int")
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == 904 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) and x.held_out is not None for x in rows)
    got = [(truth[x.doc_id], x.predicted) for x in rows if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert sum(p for t, p in got if t) >= 0.85 * sum(t for t, _ in got) and sum(p for t, p in got if not t) <= 0.05 * len(got)
    empty = [x.score for x in rows if x.doc_id in (5000, 5001)]
    assert len(set(empty)) == 1 and empty[0] < 0.5


def test_features_are_distinct_words_and_pieces():
    h = Hasher()
    one, two, three, none = toxicity.hashed(pa.array(["abc ABC abcdefg", "abcdefg", "abcdefgh", None]), h)
    assert len(one) == 4 and len(two) == 3 and len(three) == 4 and len(none) == 0 and set(two) < set(one) and len(set(two) & set(three)) == 2


def _crf(seed):
    r = np.random.default_rng(seed)
    return Crf(r.normal(size=N_FEATURES), r.normal(size=(2, 2)), r.normal(size=2), np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.5)


@pytest.mark.parametrize("seed", range(4))
def test_chain_against_all_paths(seed):
    crf, r = _crf(seed), np.random.default_rng(seed)
    lengths = [0, 1, 5, 3, 7, 0]
    first = np.cumsum([0, *lengths])
    e = np.stack([np.zeros(first[-1]), r.normal(size=first[-1])], axis=1)
    p, z, _ = crf.marginals(e, first)
    best = crf.viterbi(e, first)
    total = 0.0
    for i, n in enumerate(lengths):
        if not n:
            continue
        own = e[first[i] : first[i + 1]]
        paths = list(itertools.product((0, 1), repeat=n))
        score = np.array([crf.start[s[0]] + sum(own[t, s[t]] for t in range(n)) + sum(crf.trans[s[t - 1], s[t]] for t in range(1, n)) for s in paths])
        weight = np.exp(score)
        total += np.log(weight.sum())
        want = [(weight * np.array([s[t] for s in paths])).sum() / weight.sum() for t in range(n)]
        np.testing.assert_allclose(p[first[i] : first[i + 1], 1], want)
        assert tuple(best[first[i] : first[i + 1]]) == paths[int(score.argmax())]
    assert abs(z - total) < 1e-9


def test_quality_of_held_out_rows(spark):
    """On the driver's own table, by rows that the fit hasn't seen."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_crf.report(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    right = sum(int(x.predicted == x.quality) for x in rows)
    assert len(rows) > 50 and right >= 0.9 * len(rows)


def test_quality_defined_results(spark):
    docs = spark.createDataFrame([(1, "good line here\nand one more", "x"), (2, "## || ##\n%% && <<", "x"), (3, None, "x"), (None, "", "x"), (3, None, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality_crf.report(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= x.score <= 1 and x.held_out is not None for x in rows) and len({x.score for x in rows if x.doc_id in (3, None)}) == 1
    assert quality_crf.report(docs.where("false"), labels).count() == 0 and quality_crf.report(docs, labels.where("false")).count() == 5


def test_base_rules_against_plain_counts():
    import re

    r = np.random.default_rng(7)
    signs = ["a", "b", "c", "é", "#", "*", "|", "<", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\xa0", "word", "a b c"]
    texts = ["".join(r.choice(signs, int(r.integers(0, 60)))) for _ in range(800)] + [None, "", " \n "]
    got = quality_rules.counts(read_lines(pa.array(texts, pa.string()), Hasher()))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert [got[k][i] for k in quality_rules.COUNTS] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)], repr(t)
