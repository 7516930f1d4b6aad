"""Licence notices found with a positional index of rare words.

The index has the postings (template, position) of every word of the licence templates.  How rare a word is comes from all documents: one
pass counts in how many each word of the index occurs.  A second pass looks up, for each document and template that share enough weight of words, the
``ANCHORS`` rarest of their common words, and intersects postings with the document's positions: places of one offset (position in the
document less position in the template, within ``SLACK``) vote together.  Where enough weight agrees, all the template's words are aligned
around that offset, and the template's key phrases must stand there word for word.  The base phrases are found directly.  No row is
shuffled; the index and its weights, some hundred words, travel to the executors.

Defined results: a null or empty text has no words, no places, empty labels and score 0; repeated rows, and rows with a null doc_id, give a row each; a text
of any length is searched whole; of equally good offsets of a template the first counts; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shipped
from .textkit import Hasher, alnum_words, eights, lower_ascii, same_bytes, slices, utf8, word_spans

#: Rarest common words that vote; words by which places may be off; shares of weight that must be common, agree in offset, and be aligned.
ANCHORS, SLACK, COMMON, AGREE, ALIGNED = 5, 6, 0.6, 0.5, 0.6
#: The least weight of a word, however common it is.
LEAST_WEIGHT = 0.1

# The phrases of the base and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices by which public licences are given, as words.
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version"
_SHORT = "licensed under the gnu {0} version {1}"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_CC = "this work is licensed under a creative commons {0} 4 0 international license"
_GNU = {"gpl-2": ("general public license", "2"), "gpl-3": ("general public license", "3"), "lgpl-3": ("lesser general public license", "3"), "agpl-3": ("affero general public license", "3")}
_CREATIVE = {"cc-by": ("attribution", "cc by"), "cc-by-sa": ("attribution sharealike", "cc by sa"), "cc-by-nc": ("attribution noncommercial", "cc by nc"), "cc-by-nd": ("attribution noderivatives", "cc by nd"), "cc-by-nc-sa": ("attribution noncommercial sharealike", "cc by nc sa")}
#: (label, words, key phrases): each key is a list of phrases, one of which must stand where the template does.
TEMPLATES: list[tuple[str, str, list[list[str]]]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", [["permission is hereby granted free of charge"]]),
    ("mit", "released under the mit license", [["the mit license"]]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", [["apache license version 2"]]),
    ("bsd-2", _BSD, [["redistribution and use in source and binary forms"]]),
    ("bsd-3", _BSD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", [["redistribution and use in source and binary forms"], ["neither the name of"]]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", [["with or without fee is hereby granted"]]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", [["mozilla public license"]]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1 0 universal", [["waived all copyright and related or neighboring rights", "cc0 1 0"]]),
    ("unlicense", "this is free and unencumbered software released into the public domain", [["free and unencumbered software"]]),
    *((label, shape.format(name, number), [[f"gnu {name}"], [f"version {number}"]]) for label, (name, number) in _GNU.items() for shape in (_GPL, _SHORT)),
    *((label, _CC.format(name), [[f"creative commons {name} 4", f"creative commons {name} international"]]) for label, (name, _) in _CREATIVE.items()),
    *((label, f"licensed under {short} 4 0", [[f"{short} 4"]]) for label, (_, short) in _CREATIVE.items()),
]
#: A label that says no more where another is found at the same place.
WITHIN = {"bsd-2": "bsd-3"}


class Index:
    """Words of the templates and base phrases by number, their weights, and the templates as numbers."""

    def __init__(self, templates: list = TEMPLATES, base: dict[str, str] = BASE) -> None:
        texts = [*base, *(t for _, t, _ in templates), *(p for _, _, keys in templates for key in keys for p in key)]
        self.words = sorted({w for t in texts for w in t.split()})
        number = {w: i for i, w in enumerate(self.words)}
        as_numbers = lambda t: np.array([number[w] for w in t.split()])
        self.base = [(label, as_numbers(p)) for p, label in base.items()]
        self.templates = [(label, as_numbers(t), [[as_numbers(p) for p in key] for key in keys]) for label, t, keys in templates]
        self.weigh({}, 0)
        raw = [w.encode() for w in self.words]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(w) for w in raw])
        self.begin = np.cumsum(self.size) - self.size
        h = Hasher().spans(self.raw, self.begin, self.begin + self.size)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def weigh(self, documents_with: dict[str, int], documents: int) -> None:
        """Weights from how many documents have each word, of how many there are."""
        self.weight = np.array([max(LEAST_WEIGHT, math.log((1 + documents) / (1 + documents_with.get(w, 0)))) for w in self.words])
        self.distinct = [np.unique(t) for _, t, _ in self.templates]
        self.member = np.zeros((len(self.words), len(self.templates)))
        for j, d in enumerate(self.distinct):
            self.member[d, j] = self.weight[d]
        self.rarest = [d[np.argsort(-self.weight[d], kind="stable")] for d in self.distinct]

    def numbers(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each word's number, -1 for words that the index doesn't have; equality is that of bytes."""
        h = Hasher().spans(raw, begin, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        maybe = np.flatnonzero(self.hashes[at] == h)
        which = self.order[at[maybe]]
        same = same_bytes(eights(raw), begin[maybe], end[maybe] - begin[maybe], eights(self.raw), self.begin[which], self.size[which])
        out = np.full(len(h), -1, np.int64)
        out[maybe[same]] = which[same]
        return out

    def presence(self, v: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(texts, words): which words each text has."""
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        there = np.zeros((len(first) - 1, len(self.words)), bool)
        there[of[v >= 0], v[v >= 0]] = True
        return there


def standing(v: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after another."""
    n = len(v) - len(phrase) + 1
    at = np.flatnonzero(v[: max(n, 0)] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[v[at + j] == phrase[j]]
    return at


def _matches(index: Index, v: np.ndarray, present: np.ndarray, j: int) -> list[tuple[int, int, float]]:
    """(first word, last word, aligned share of weight) of template j in one text of word numbers v."""
    _, template, keys = index.templates[j]
    anchors = [w for w in index.rarest[j] if present[w]][:ANCHORS]
    weight = index.weight[anchors]
    offsets = []
    for w in anchors:
        p, q = np.flatnonzero(v == w), np.flatnonzero(template == w)
        offsets.append(np.unique(p[:, None] - q[None, :]))
    centres = np.unique(np.concatenate(offsets))
    votes = sum(x * (np.searchsorted(d, centres + SLACK, "right") > np.searchsorted(d, centres - SLACK, "left")) for x, d in zip(weight, offsets))
    good = np.flatnonzero(votes >= AGREE * weight.sum())
    out = []
    while len(good):  # offsets within the slack of one another are one place
        gap = np.flatnonzero(np.diff(centres[good]) > SLACK)
        group, good = good[: gap[0] + 1] if len(gap) else good, good[gap[0] + 1 :] if len(gap) else good[:0]
        d = int(centres[group[np.argmax(votes[group])]])
        low = max(0, d - SLACK)
        near = v[low : d + len(template) + SLACK]
        aligned = np.zeros(len(template), bool)
        for q, w in enumerate(template):
            lo = max(0, d + q - SLACK - low)
            aligned[q] = (near[lo : max(0, d + q + SLACK + 1 - low)] == w).any()
        each = index.weight[template]
        share = float(each[aligned].sum() / each.sum())
        if share >= ALIGNED and all(any(len(standing(near, p)) for p in key) for key in keys):
            out.append((max(d, 0), min(d + len(template), len(v)) - 1, share))
    return out


SCANNED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("base", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType())]))), T.StructField("found", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("share", T.DoubleType())])))])
_BASE_ARROW = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
_FOUND_ARROW = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))


def _words(batch: pa.RecordBatch, index: Index) -> tuple[np.ndarray, np.ndarray]:
    raw, at = utf8(batch.column("text"))
    raw = lower_ascii(raw)
    begin, end, first = word_spans(raw, at, alnum_words())
    return index.numbers(raw, begin, end), first


def weighed(docs: DataFrame, index: Index) -> Index:
    """The index with weights from all documents; what comes to the driver is one number a word of the index."""
    fetch = shipped(docs.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, documents = fetch(), None, 0
        for whole in batches:
            for batch in slices(whole):
                seen = index.presence(*_words(batch, index)).sum(axis=0)
                total, documents = seen if total is None else total + seen, documents + batch.num_rows
        if documents:
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(total)), -1], pa.int32()), pa.array([*total.tolist(), documents], pa.int64())], ["word", "n"])

    counted = dict(docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n")).collect())
    index.weigh({w: counted.get(i, 0) for i, w in enumerate(index.words)}, counted.get(-1, 0))
    return index


def _scan(fetch: Callable[[], Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = fetch()
        total = index.member.sum(axis=0)
        for whole in batches:
            for batch in slices(whole):
                v, first = _words(batch, index)
                present = index.presence(v, first)
                likely = present @ index.member >= COMMON * total
                of = lambda at: np.searchsorted(first, at, "right") - 1
                base: list[list] = [[] for _ in range(batch.num_rows)]
                for label, phrase in index.base:
                    at = standing(v, phrase)
                    i = of(at)
                    for p, k in zip(at[i == of(at + len(phrase) - 1)].tolist(), i[i == of(at + len(phrase) - 1)].tolist()):
                        base[k].append({"label": label, "first": p - int(first[k])})
                found: list[list] = [[] for _ in range(batch.num_rows)]
                for k, j in zip(*np.nonzero(likely)):
                    own = v[first[k] : first[k + 1]]
                    found[k] += [{"label": index.templates[j][0], "first": a, "last": b, "share": s} for a, b, s in _matches(index, own, present[k], j)]
                found = [[x for x in own if not any(y["label"] == WITHIN.get(x["label"]) and y["first"] <= x["last"] and x["first"] <= y["last"] for y in own)] for own in found]
                others = [batch.column(c) for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*others, pa.array(np.diff(first), pa.int64()), pa.array(base, _BASE_ARROW), pa.array(found, _FOUND_ARROW)], [*(c for c in batch.schema.names if c != "text"), "n_words", "base", "found"])

    return run


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """Per document doc_id, n_words, base (label and first word of each place of a base phrase) and found (label, first and last word, aligned share of each template's place)."""
    docs = docs.select("doc_id", "text")
    index = weighed(docs, index or Index())
    return docs.mapInArrow(_scan(shipped(docs.sparkSession, index)), T.StructType([docs.schema["doc_id"], *SCANNED.fields]))


def report(docs: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, found = F.col("base.label"), F.col("found.label")
    return scan(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, found)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.share"), F.lit(0.0))).alias("score"), "found",
    )
