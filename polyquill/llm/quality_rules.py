"""Quality rules: counts over words and lines, and a line labelling by Viterbi decoding.

The conditional random field of ``linecrf`` marks each line content or boilerplate; a text is retained if content lines have
at least ``CONTENT_SHARE`` of its line bytes and it doesn't fail the base rules (fewer than 50 words, or more than
half of its words in repeated 3-word windows).

Defined results: a text without words (null, empty or blank) has all counts 0, fails the base rules and isn't kept;
repeated rows, and rows with a null doc_id, are judged alike; of two labellings of equal weight the one with boilerplate at the last line where they differ
counts, and a share of exactly ``CONTENT_SHARE`` is kept; texts of any length are labelled whole; other columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .linecrf import _HEAD, _SYMBOLS, Crf, Lines, features, read_lines
from .shared import free_names, shipped
from .textkit import Hasher, mix, slices, windows

CONTENT_SHARE, MIN_WORDS, MAX_REPEAT_PERCENT = 0.5, 50, 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(x: Lines) -> dict[str, np.ndarray]:
    n = len(x.at) - 1
    n_words = np.diff(x.word_first)
    heads = np.zeros(len(x.raw) + 1, np.int64)
    np.cumsum(_HEAD[x.raw], out=heads[1:])
    in_word = np.concatenate([[0], np.cumsum(heads[x.word_end] - heads[x.word_begin])])
    symbols = np.zeros(len(x.raw) + 1, np.int64)
    np.cumsum(_SYMBOLS[x.raw], out=symbols[1:])
    grams, gf = windows(x.words, x.word_first, 3, 3)
    doc = np.repeat(np.arange(n), np.diff(gf))
    _, inverse, count = np.unique(grams + mix(doc.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1) if len(grams) else np.zeros(0, np.int64)
    place = twice - gf[doc[twice]] + x.word_first[doc[twice]]
    covered = np.zeros(len(x.words), bool)
    for j in range(3):
        covered[place + j] = True
    repeat = np.concatenate([[0], np.cumsum(covered)])
    return {
        "n_words": n_words,
        "word_chars": in_word[x.word_first[1:]] - in_word[x.word_first[:-1]],
        "n_symbols": symbols[x.at[1:]] - symbols[x.at[:-1]],
        "n_dup_lines": np.bincount(x.doc[x.repeats], minlength=n),
        "n_repeat_words": repeat[x.word_first[1:]] - repeat[x.word_first[:-1]],
    }


JUDGED = (*COUNTS, "base_failed", "content_share", "kept")


def judge(docs: DataFrame, crf: Crf, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed, content_share (share of bytes in content lines) and kept, under new names where docs has these."""
    return judged(docs, crf, text)[0]


def judged(docs: DataFrame, crf: Crf, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``judge``, and what each of its columns is called."""
    model = shipped(docs.sparkSession, crf)
    names = list(docs.columns)
    called = dict(zip(JUDGED, free_names(names, *JUDGED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, crf = Hasher(), model()
        for whole in batches:
            for batch in slices(whole, text):
                x = read_lines(batch.column(text), hasher)
                c = counts(x)
                state = crf.viterbi(crf.emissions(features(x)), x.first)
                size = (x.end - x.begin).astype(float)
                share = np.bincount(x.doc, size * state, batch.num_rows) / np.maximum(np.bincount(x.doc, size, batch.num_rows), 1)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                new = [*(pa.array(c[k], pa.int64()) for k in COUNTS), pa.array(failed), pa.array(share), pa.array(~failed & (share >= CONTENT_SHARE))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *new], [*names, *called.values()])

    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    added = [T.StructField(k, t) for k, t in zip(called.values(), kinds)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added])), called
