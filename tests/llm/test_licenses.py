"""Licence notices against regular expressions and planted texts."""

import re

import pytest

from polyquill.llm import licenses as L

FILL = "lorem ipsum dolor sit amet the under version of work".split()


def _around(notice, n, seed=0):
    fill = [FILL[(i * 7 + seed) % len(FILL)] + ("" if i % 3 else str(i)) for i in range(n)]
    return " ".join(fill[: n // 2]) + "\n" + notice + "\n" + " ".join(fill[n // 2 :])


TEXTS = [
    None, "", " \n", "under the MIT License", "Under the mit-license; under the\nMIT license, again under the mit license",
    _around("Licensed under the Apache License, Version 2.0.", 400), _around("licensed under CC BY-NC 4.0.", 50), "apache license version 20", "apache license version", "é under the mit license é", "underthe mit license",
    _around("This work is licensed under the GNU General Public License, version 3.", 300), _around("This work is licensed under the GNU General Public License, version 2.", 300),
    _around(L.TEMPLATES[0][1].upper(), 30), _around(L.TEMPLATES[0][1].replace("free of charge", "gratis"), 30), _around(L.TEMPLATES[4][1].replace("the copyright holder", "the University of Somewhere"), 100), _around(L.TEMPLATES[3][1], 100),
    "version 3 of the public works: a license to print general gnu", "4 0 by cc under licensed", _around("under the mit license " * 2000, 100000), _around("licensed under cc by-sa 4.0", 200),
]
WANTED = {5: "apache-2", 6: "cc-by-nc", 11: "gpl-3", 12: "gpl-2", 13: "mit", 14: "", 15: "bsd-3", 16: "bsd-2", 17: "", 18: "", 20: "cc-by-sa"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0, "x"), (None, TEXTS[3], 0, "x")], "doc_id long, text string, n_words int, base string")


def test_base_columns_equal_regular_expressions(docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = L.report(docs.repartition(3)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[3] if r.doc_id is None else TEXTS[r.doc_id] or ""
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_notices_are_labelled(docs):
    got = {r.doc_id: r for r in L.report(docs).collect()}
    assert {i: got[i].labels for i in WANTED} == WANTED
    at = next(x for x in got[11].found if x.label == "gpl-3")
    assert 140 <= at.first <= 160 and at.last < 175


def test_empty_table(docs):
    assert L.report(docs.where("false")).count() == 0
