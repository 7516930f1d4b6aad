"""Base spans against regular expressions on random texts, added spans on freshly drawn templates, and very many matches."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from polyquill.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def base(t):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if passes(kind, m[0])]
    return sorted(found)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def test_base_spans(spark):
    r = random.Random(4)
    pieces = ["1.2.3.4", "999.1.1.1", "1.2.3.999", "99999.1.1.1", "0255.0.0.1", "256.1.1.1", "1.2.3.4.5", "a@b.c", "x.y@z", "@", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234567", "+1", " ", " ", ".", "-", "é", "\U0001f600", "﷐", "\n", "(", "7"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, "", "  "]
    texts += ["".join(r.choice("0123456789.@a+ -()") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    docs = spark.createDataFrame([(i if i else None, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, _base string")
    for row in pii.report(docs).collect():
        t = texts[row.doc_id or 0]
        want = base(t.replace("﷐", "�") if t else t)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(w[1] == k for w in want) for k in range(4)]
        assert {x for x in joined.split(",") if x} <= set(row.spans.split(",")), t


def test_added_spans_are_found_and_look_alikes_left_alone(spark, model):
    rows = pii.labelled_table(seed=1234)
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")
    d, _, spans = pii.with_spans(docs, model)
    got = {r.doc_id: r.s for r in d.select("doc_id", pii.joined(F.col(spans)).alias("s")).collect()}
    hit = [0, 0]
    count = [0, 0]
    for i, (text, s, e, k, y) in enumerate(rows):
        certain = [(a, b) for a, _, b, _ in base(text)]
        if y and any(a < e and s < b for a, b in certain):
            continue  # a base span has it
        count[y] += 1
        hit[y] += f"{pii.KINDS[k]}:{s}:{e}" in got[i].split(",")
    assert hit[1] >= 0.9 * count[1] and hit[0] <= 0.03 * count[0], (hit, count)


def test_overlapping_candidates(spark, model):
    """The sweep keeps what a comparison of all pairs keeps, ties included."""
    r = random.Random(8)
    for trial in range(40):
        spans = []
        for k in range(4):  # spans of a kind don't overlap
            at = 0
            for _ in range(r.randint(0, 6)):
                at += r.randint(0, 4)
                end = at + r.randint(1, 12)
                spans.append((at, k, end, float(r.randint(0, 2))))
                at = end
        key = lambda x: (x[3], -x[0], x[2], -x[1])
        want = sorted(x for x in spans if not any(o[0] < x[2] and x[0] < o[2] and key(o) > key(x) for o in spans))
        each = [",".join(f"named_struct('s',{s},'k',{k},'e',{e},'v',{v}d)" for s, k, e, v in spans if k == kind) for kind in range(4)]
        arrays = ",".join(f"cast(array({x}) as array<struct<s:int,k:int,e:int,v:double>>)" for x in each)
        got = spark.range(1).select(pii._best(F.expr(f"array({arrays})")).alias("x")).first().x
        assert sorted((x.s, x.k, x.e, x.v) for x in got) == want


def test_very_many_matches_and_an_empty_table(spark, model):
    n = 2_000
    text = " ".join(f"call (212) 555-{i % 10000:04d} or a{i}@b.org, at 10.0.0.{i % 300};" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.report(docs).first()
    assert row.n_email == n and row.n_ip == sum(i % 300 <= 255 for i in range(n)) and row.spans.count("phone") == n
    d, _, spans = pii.with_spans(docs, model)
    clean = d.select(pii.redacted(F.col("text"), F.col(spans))).first()[0]
    assert clean.count("[PHONE]") == n and "@" not in clean and time.time() - began < 90
    assert pii.report(docs.where("false")).count() == 0
