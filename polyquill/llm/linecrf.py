"""A two-state linear-chain conditional random field over the lines of a text.

A line is a run of bytes between line feeds that holds a word.  Its features are shares of symbols, capitals,
digits and the like, how its words repeat, whether it repeats an earlier line, and the same shares averaged
over the neighbouring lines.  State 1 is a good (content) line, state 0 a bad (boilerplate) one.

Training maximises the regularised likelihood of line labels over a bounded sample of labelled texts,
every line having its text's label; the chain's transitions then learn how labels persist.  All recursions run
over a whole batch of texts at once.

Defined results: a null, empty or blank text has no lines; labels with a null doc_id or value don't count; texts that share a labelled doc_id are each learned from, as far as the
bounds allow, and a doc_id with two labels with both; of equal hashes the lesser doc_id, label and number of lines goes first; a very long text is learned from whole or, beyond the bound of lines, not
at all; without labels the untrained chain is the model; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textkit import Hasher, mix, slices, space_words, utf8, word_spans

#: Labelled texts used for training: those with the least hash of doc_id.
SAMPLE_ROWS = 2500
#: Lines used for training, of all its texts together (scoring uses all).
SAMPLE_LINES = 1_000_000

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8))
_HEAD = (np.arange(256) & 0xC0) != 0x80  # a byte that begins a code point
N_OWN = 10
N_FEATURES = 1 + N_OWN + 6 + 1


@dataclass
class Lines:
    """The texts of a slice by words and lines; line_first[i] is text i's first line, and so on."""

    raw: np.ndarray
    at: np.ndarray
    word_begin: np.ndarray
    word_end: np.ndarray
    word_first: np.ndarray
    words: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    repeats: np.ndarray  # equal to an earlier line of its text


def read_lines(texts: pa.Array, hasher: Hasher) -> Lines:
    raw, at = utf8(texts)
    wb, we, wf = word_spans(raw, at, space_words())
    h = hasher.spans(raw, wb, we)
    not_feed = np.ones(256, bool)
    not_feed[10] = False
    lb, le, _ = word_spans(raw, at, not_feed)
    has_word = np.searchsorted(wb, le) > np.searchsorted(wb, lb)
    lb, le = lb[has_word], le[has_word]
    lf = np.searchsorted(lb, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(lf))
    key = hasher.spans(raw, lb, le) + mix(doc.astype(np.uint64) + np.uint64(1))
    _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
    repeats = index[inverse] != np.arange(len(lb)) if len(lb) else np.zeros(0, bool)
    return Lines(raw, at, wb, we, wf, h, lb, le, lf, doc, repeats)


def features(x: Lines) -> np.ndarray:
    """(lines, N_FEATURES) values, unscaled; column 0 is 1."""
    n = len(x.begin)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(x.raw) + 1, np.int64)
        np.cumsum(table[x.raw], out=sums[1:])
        return (sums[x.end] - sums[x.begin]) / np.maximum(x.end - x.begin, 1)

    w0, w1 = np.searchsorted(x.word_begin, x.begin), np.searchsorted(x.word_begin, x.end)
    count = w1 - w0
    line = np.repeat(np.arange(n), count)
    key = x.words + mix(line.astype(np.uint64) + np.uint64(7))
    distinct = np.bincount(line[np.unique(key, return_index=True)[1]], minlength=n) if n else np.zeros(0)
    same = np.zeros(len(x.words), bool)
    same[1:] = (x.words[1:] == x.words[:-1]) & (line[1:] == line[:-1])
    adjacent = np.bincount(line[same], minlength=n) if n else np.zeros(0)
    many = np.maximum(count, 1)
    own = np.stack([
        share(_SYMBOLS), share(_UPPER), share(_MARKS), share(_DIGIT), share(_STOPS), 1 - distinct / many, adjacent / many, x.repeats.astype(float), np.log1p(count) / 5, np.minimum((x.end - x.begin) / many, 40) / 10,
    ], axis=1) if n else np.zeros((0, N_OWN))
    before, after = np.zeros((n, 6)), np.zeros((n, 6))
    some = own[:, [0, 1, 2, 5, 6, 7]]
    if n > 1:
        joined = x.doc[1:] == x.doc[:-1]
        before[1:][joined] = some[:-1][joined]
        after[:-1][joined] = some[1:][joined]
    alone = np.diff(x.first)[x.doc] == 1 if n else np.zeros(0)
    return np.concatenate([np.ones((n, 1)), own, (before + after) / 2, np.asarray(alone, float)[:, None]], axis=1)


def _padded(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty texts by falling number of lines, and for step t how many of them have a line t."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    order = order[: int((n > 0).sum())]
    lengths = n[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    return order, lengths, active


@dataclass
class Crf:
    weight: np.ndarray  # of state 1 over state 0
    trans: np.ndarray  # (2, 2)
    start: np.ndarray  # (2,)
    mean: np.ndarray
    scale: np.ndarray
    prior: float  # share of good texts among those trained on; the score of a text without lines

    def emissions(self, f: np.ndarray) -> np.ndarray:
        e = np.zeros((len(f), 2))
        e[:, 1] = ((f - self.mean) / self.scale) @ self.weight
        return e

    def marginals(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """P(state) of each line by forward-backward, the log partition sum, and expected transitions."""
        order, lengths, active = _padded(first)
        p, pairs, z = np.zeros((len(e), 2)), np.zeros((2, 2)), 0.0
        if not len(order):
            return p, z, pairs
        base, steps = first[:-1][order], len(active)
        alpha, beta = np.zeros((len(e), 2)), np.zeros((len(e), 2))
        alpha[base] = self.start + e[base]
        for t in range(1, steps):
            i = base[: active[t]] + t
            alpha[i] = np.logaddexp(alpha[i - 1, 0, None] + self.trans[0], alpha[i - 1, 1, None] + self.trans[1]) + e[i]
        for t in range(steps - 1, 0, -1):
            i = base[: active[t]] + t
            x = e[i] + beta[i]
            beta[i - 1] = np.logaddexp(self.trans[:, 0] + x[:, :1], self.trans[:, 1] + x[:, 1:])
        ends = base + lengths - 1
        total = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
        of_line = np.empty(len(e))
        of_line[:] = np.repeat(self._spread(total, order, len(first) - 1), np.diff(first))
        p = np.exp(alpha + beta - of_line[:, None])
        inner = np.ones(len(e), bool)
        inner[base] = False
        i = np.flatnonzero(inner)
        joint = alpha[i - 1][:, :, None] + self.trans[None] + (e[i] + beta[i])[:, None, :] - of_line[i][:, None, None]
        return p, float(total.sum()), np.exp(joint).sum(axis=0)

    @staticmethod
    def _spread(values: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        out[order] = values
        return out

    def viterbi(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The most probable state of each line, jointly; of equal paths the one with state 1."""
        order, lengths, active = _padded(first)
        state = np.zeros(len(e), np.int8)
        if not len(order):
            return state
        base, best = first[:-1][order], np.zeros((len(e), 2))
        back = np.zeros((len(e), 2), np.int8)
        best[base] = self.start + e[base]
        for t in range(1, len(active)):
            i = base[: active[t]] + t
            x = best[i - 1][:, :, None] + self.trans[None]
            back[i] = x[:, 1, :] >= x[:, 0, :]
            best[i] = np.maximum(x[:, 0, :], x[:, 1, :]) + e[i]
        ends = base + lengths - 1
        state[ends] = best[ends, 1] >= best[ends, 0]
        for t in range(len(active) - 1, 0, -1):
            i = base[: active[t]] + t
            state[i - 1] = back[i, state[i]]
        return state


def fit(f: np.ndarray, first: np.ndarray, good: np.ndarray, steps: int = 160, decay: float = 2e-4, rate: float = 0.08) -> Crf:
    """Adam on the regularised log likelihood; good: 0 or 1 of each text."""
    n_lines = np.diff(first)
    if not len(f) or len(set(good.tolist())) < 2:  # nothing to tell apart: every line is good
        return Crf(np.zeros(N_FEATURES), np.zeros((2, 2)), np.array([0.0, 1.0]), np.zeros(N_FEATURES), np.ones(N_FEATURES), float(good.mean()) if len(good) else 0.5)
    mean, scale = f.mean(axis=0), np.maximum(f.std(axis=0), 1e-3)
    mean[0], scale[0] = 0, 1
    crf = Crf(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2), mean, scale, float(good.mean()))
    y = np.repeat(good, n_lines).astype(int)
    x = (f - mean) / scale
    inner = np.ones(len(f), bool)
    inner[first[:-1][n_lines > 0]] = False
    seen = np.zeros((2, 2))
    i = np.flatnonzero(inner)
    np.add.at(seen, (y[i - 1], y[i]), 1)
    begun = np.bincount(y[~inner], minlength=2)
    m = [np.zeros(N_FEATURES + 6), np.zeros(N_FEATURES + 6)]
    for step in range(1, steps + 1):
        p, _, pairs = crf.marginals(crf.emissions(f), first)
        g = np.concatenate([x.T @ (p[:, 1] - y), (pairs - seen).ravel(), p[~inner].sum(axis=0) - begun]) / len(f)
        theta = np.concatenate([crf.weight, crf.trans.ravel(), crf.start])
        g += decay * theta
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.99 * m[1] + 0.01 * g * g
        theta = theta - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
        crf.weight, crf.trans, crf.start = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[N_FEATURES + 4 :]
    return crf


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for whole in batches:
        for batch in slices(whole):
            x = read_lines(batch.column("text"), hasher)
            f = features(x).astype(np.float32)
            rows = [f[x.first[i] : x.first[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(np.diff(x.first).astype(np.int64)), pa.array(rows, pa.binary())], ["doc_id", "good", "n", "f"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, lines: int = SAMPLE_LINES) -> Crf:
    """Fits to at most ``rows`` labelled texts (rows of docs), each whole, of at most ``lines`` lines together (a text beyond that is left out); labels with null keys or values don't count."""
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("good"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "good", "text")
    read = cut(sample.mapInArrow(_extract, "doc_id long, good int, n long, f binary").withColumn("row", F.monotonically_increasing_id()))
    taken, left = [], lines
    for r in read.select("row", "n").orderBy(F.xxhash64("doc_id"), "doc_id", "good", "n", "row").limit(rows).collect():  # also where ids repeat
        if r.n <= left:
            taken.append((r.row,))
            left -= r.n
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, "row long"))
    got = read.join(chosen, "row").select("doc_id", "good", "f").toPandas().sort_values("doc_id", kind="stable")
    parts = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got["f"]]
    f = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, N_FEATURES))
    return fit(f, np.cumsum([0, *map(len, parts)]), got["good"].to_numpy().astype(int))
