"""Collocations against counting in plain Python, and the pair filter."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from polyquill.llm import collocations as C


def plain(rows, least, share, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    inner = {}
    for (lang, *w), v in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = (lang, *w[i : i + m])
                inner[key] = max(inner.get(key, 0), v)
    found = {}
    for (lang, *w), a in f.items():
        if len(w) > 1 and not 100 * inner.get((lang, *w), 0) >= share * a:
            score, k = min((Fraction(2_000_000 * a, f[(lang, *w[:k])] + f[(lang, *w[k:])]).__floor__(), k) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {(lang, i, p.decode(), -a, le, r, n[lang], -s) for lang, all_ in found.items() for i, (s, a, p, le, r) in enumerate(sorted(all_)[:top], 1)}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = "The the aa bb cc dd ee ff é É ü# 1".split()
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ", "]) for _ in range(r.randrange(60)))
    out = [(text(), r.choice(["en", "en", "en", "de", None, "und"])) for _ in range(400)]
    return [*out, (None, "en"), ("", "fr"), (None, None), (" ".join(["same"] * 5000), "en"), ("alpha beta gamma delta " * 3000, "en"), *[("twice told tale", "fr")] * 40]


@pytest.mark.parametrize(("least", "top", "bytes_"), [(5, 50, 8_000_000), (30, 2000, 2000), (1, 40, 500)])
def test_equal_to_plain_counting(spark, rows, monkeypatch, least, top, bytes_):
    monkeypatch.setattr(C, "SHARD_BYTES", bytes_)
    df = spark.createDataFrame([(*x, 7, "clash") for x in rows], "text string, lang string, f int, phrase string").repartition(6)
    got = {tuple(r) for r in C.mined(df, least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == plain(rows, least, 80, top)


def test_filter_keeps_every_pair(spark):
    pairs = [("en" if i % 2 else "de", f"w{i} x{i * 7}") for i in range(5000)]
    bits = C.pair_filter(spark.createDataFrame(pairs, "lang string, phrase string").repartition(3))
    import pyarrow as pa

    for lang in ("en", "de"):
        own = [p for k, p in pairs if k == lang]
        shard = C.Shard(pa.array(own), pa.array([lang] * len(own)))
        shard.likely(bits)
        assert (shard.left[::2] == 2).all()
        other = C.Shard(pa.array([p + "y" for p in own]), pa.array([lang] * len(own)))
        other.likely(bits)
        assert (other.left == 2).mean() < 0.01


def test_empty_and_unfrequent(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string")
    assert C.mined(df.where("false")).count() == 0
    assert C.mined(df.limit(3), least=100_000).count() == 0
