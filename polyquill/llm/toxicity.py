"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over the presence of hashed words, of six-byte pieces of words, and of stems that several words of a text share, is trained in numpy on confirmed toxic texts (P) and on
texts taken as unlabelled (U): documents without a label, and the labelled training rows without regard to their labels.
With the class prior pi and the loss l, the risk is pi * E_P[l(+)] + max(0, E_U[l(-)] - pi * E_P[l(-)]); where the second part falls under zero,
the step goes against its gradient (Kiryo et al., 2017).  The prior is the share of toxic texts among the labelled training rows.  Only the
features whose presence differs most between P and U have a weight, as many as the best of ``FEATURES``.  Training texts are at most ``SAMPLE_ROWS`` labelled and ``UNLABELLED_ROWS`` unlabelled ones by hash of
doc_id; scoring covers all.  Decay, number of features and the offset, which puts 0.5 at the F1-best cut, are chosen on labelled training rows by cross-fitting.

Defined results: a null or empty text has no words and scores the model's offset; repeated rows, and rows with a null doc_id (not held out), score alike; without
confirmed toxic rows every score is 0; of equal features the lower number has the weight, of equal choices the fewer features, then the lesser decay, of equal cuts the higher; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import _BASE, Hasher, alnum_words, eights, lower_ascii, mix, slices, utf8, word_spans

SAMPLE_ROWS, UNLABELLED_ROWS, BITS, PIECE, FEATURES = 6000, 2000, 20, 6, (150, 500, 3000)
STEPS, RATE, DECAYS, LEAST_ROWS = 200, 0.05, (3e-4, 1e-3, 3e-3), 4


def hashed(texts: pa.Array, hasher: Hasher) -> list[np.ndarray]:
    """The distinct feature numbers of each text: its words, the pieces of its longer words, and the stems (first ``PIECE`` bytes) that two or more different longer words of it share."""
    raw, at = utf8(texts)
    raw = lower_ascii(raw)
    begin, end, first = word_spans(raw, at, alnum_words())
    size = np.maximum(end - begin - PIECE + 1, 0)
    size[end - begin == PIECE] = 0  # the word itself is a feature
    place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    pieces = mix((eights(raw)[place] & np.uint64((1 << 8 * PIECE) - 1)) + _BASE)
    word = hasher.spans(raw, begin, end)
    long = np.flatnonzero(size)
    stem = eights(raw)[begin[long]] & np.uint64((1 << 8 * PIECE) - 1)
    order = np.lexsort((word[long], stem, text[long]))  # different words of a stem lie together
    t, st, w = text[long][order], stem[order], word[long][order]
    same = (t[1:] == t[:-1]) & (st[1:] == st[:-1])
    shared = np.flatnonzero(same & (w[1:] != w[:-1]))
    slot = (np.concatenate([word, pieces, mix(st[shared] + _BASE + _BASE)]) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique((np.concatenate([text, np.repeat(text, size), t[shared]]) << BITS) | slot)
    return np.split((key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key, np.arange(1, len(at) - 1) << BITS))


def _matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows) if rows else np.zeros(0, np.int32)


def _descend(doc: np.ndarray, col: np.ndarray, n: int, k: int, value: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float) -> np.ndarray:
    """Adam on the non-negative risk: k weights and an offset."""
    p, u = positive / max(positive.sum(), 1), unlabelled / max(unlabelled.sum(), 1)
    theta, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        s = np.bincount(doc, theta[col] * value[col], n) + theta[-1]
        q, neg = 1 / (1 + np.exp(-np.clip(s, -50, 50))), np.logaddexp(0, s)
        rest = (u * neg).sum() - prior * (p * neg).sum()
        g_rest = u * q - prior * p * q
        g = prior * p * (q - 1) + g_rest if rest >= 0 else -g_rest
        grad = np.append(np.bincount(col, g[doc] * value[col], k), g.sum()) + decay * theta * np.append(np.ones(k), 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta


def _far(count: np.ndarray, hits: np.ndarray, in_u: np.ndarray, n_pos: int, n_u: int) -> np.ndarray:
    """How far presence differs between P and U, in standard errors; -1 for features of too few rows."""
    share = in_u / max(n_u, 1)
    far = np.abs(hits / max(n_pos, 1) - share) / np.sqrt(share * (1 - share) / max(n_pos, 1) + 1e-9)
    far[count < LEAST_ROWS] = -1
    return far


def _useful(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which features may have a weight in any fold, or in the model of all rows; the rest never need be laid out."""
    parts = {}
    for f in np.unique(of):
        mine = np.flatnonzero(of == f)
        one = lambda which: np.bincount(np.concatenate([np.zeros(0, np.int32), *(rows[i] for i in mine[which])]), minlength=1 << BITS).astype(np.int32)
        parts[f] = (one(np.ones(len(mine), bool)), one(positive[mine]), one(unlabelled[mine]), int(positive[mine].sum()), int(unlabelled[mine].sum()))
    total = [sum(p[i] for p in parts.values()) for i in range(5)]
    keep = np.zeros(1 << BITS, bool)
    for left_out in [None, *(f for f in parts if f >= 0)]:
        far = _far(*(t if left_out is None else t - parts[left_out][i] for i, t in enumerate(total)))
        keep[np.argsort(-far, kind="stable")[: min(max(FEATURES), int((far >= 0).sum()))]] = True
    return keep


class _Table:
    """Rows of features with their columns numbered densely."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.doc, col = _matrix(rows)
        self.slots, self.col = np.unique(col, return_inverse=True)

    def model(self, keep: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, choices: list[tuple[int, float]]) -> list[np.ndarray]:
        """For each choice (number of features, decay) the weights of all columns, and the offset, learned from the rows that ``keep`` marks: columns are chosen on these alone."""
        width = len(self.slots)
        inside = keep[self.doc]
        doc, col = (np.cumsum(keep) - 1)[self.doc[inside]], self.col[inside]
        hits, in_u, n = np.bincount(col, positive[self.doc[inside]], width), np.bincount(col, unlabelled[self.doc[inside]], width), int(keep.sum())
        count = np.bincount(col, minlength=width)
        far = _far(count, hits, in_u, int(positive[keep].sum()), int(unlabelled[keep].sum()))
        order = np.argsort(-far, kind="stable")[: int((far >= 0).sum())]
        out = []
        for features, decay in choices:
            best = np.sort(order[:features])
            place = np.full(width, -1)
            place[best] = np.arange(len(best))
            use = place[col] >= 0
            value = np.log((n + 1) / (count[best] + 1)) / 2
            theta = _descend(doc[use], place[col[use]], n, len(best), value, positive[keep], unlabelled[keep], prior, decay)
            w = np.zeros(width + 1)
            w[best], w[-1] = theta[:-1] * value, theta[-1]
            out.append(w)
        return out

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, w[self.col], self.n) + w[-1]


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, labelled: np.ndarray | None = None, unlabelled: np.ndarray | None = None, folds: int = 4) -> tuple[np.ndarray, float]:
    """Weights and offset; positive marks P, unlabelled U (by default all rows), and labelled those whose label is known, from which features, decay and cut are chosen by scores of
    folds that didn't train on them."""
    weights = np.zeros(1 << BITS)
    if not positive.any():
        return weights, -50.0
    labelled = np.ones(len(rows), bool) if labelled is None else labelled
    unlabelled = np.ones(len(rows), bool) if unlabelled is None else unlabelled
    of = np.where(labelled, (np.cumsum(labelled) - 1) % folds, -1)
    useful = _useful(rows, positive, unlabelled, of)
    table = _Table([r[useful[r]] for r in rows])
    choices = [(k, d) for k in FEATURES for d in DECAYS]
    s = np.zeros((len(choices), len(rows)))
    for f in range(folds):
        for i, w in enumerate(table.model(of != f, positive & (of != f), unlabelled, prior, choices)):
            s[i, of == f] = table.scores(w)[of == f]
    best = None
    for i, choice in enumerate(choices):
        known, truth = s[i, labelled], positive[labelled]
        order = np.argsort(-known, kind="stable")
        f1 = 2 * np.cumsum(truth[order]) / (np.arange(1, len(known) + 1) + truth.sum())
        at = int(np.argmax(f1))
        cut = (known[order[at]] + known[order[at + 1]]) / 2 if at + 1 < len(known) else known[order[at]] - 1
        if best is None or f1[at] > best[0]:
            best = (f1[at], choice, cut)
    _, choice, cut = best
    w = table.model(np.ones(len(rows), bool), positive, unlabelled, prior, [choice])[0]
    weights[table.slots] = w[:-1]
    return weights, float(w[-1] - cut)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, everyone: DataFrame | None = None) -> tuple[np.ndarray, float]:
    """Learns from at most ``rows`` labelled texts, of which those marked toxic are P, and ``unlabelled_rows`` texts that have no row in ``everyone`` (all
    labels; by default ``labels``): together they are U."""
    named = lambda d: d.where(F.col("doc_id").isNotNull()).select("doc_id")
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    # by hash, four times as many documents as are wanted; those of them that have a label go
    some = named(docs).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(4 * unlabelled_rows)
    marked = named(labels if everyone is None else everyone).join(F.broadcast(some), "doc_id", "left_semi").distinct()
    free = some.join(F.broadcast(marked), "doc_id", "left_anti").where(~_held(F.col("doc_id"))).distinct()
    free = free.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled_rows).select("doc_id", F.lit(-1).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(hashed(batch.column("text"), hasher), pa.list_(pa.int32()))], ["doc_id", "y", "f"])

    chosen = F.broadcast(picked.unionByName(free))
    found = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, f array<int>")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "f").limit(rows + unlabelled_rows).toArrow().combine_chunks()  # also where ids repeat
    order = np.lexsort((got["y"].to_numpy(), got["doc_id"].to_numpy()))
    y = got["y"].to_numpy()[order]
    known = y[y >= 0]
    lists = got["f"].combine_chunks()
    flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    feats = [flat[at[i] : at[i + 1]] for i in order]
    return fit(feats, y == 1, float(np.clip(known.mean() if len(known) else 0.1, 0.01, 0.9)), y >= 0)


def _held(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def scores(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score, predicted of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (w, offset) = Hasher(), shared.value
        for whole in batches:
            for batch in slices(whole):
                doc, col = _matrix(hashed(batch.column("text"), hasher))
                s = np.clip(np.bincount(doc, w[col], batch.num_rows) + offset, -50, 50)
                score = 1 / (1 + np.exp(-s))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that learned from those not held out (crc32 of the id modulo 5 is not 0)."""
    held = _held(F.col("doc_id"))
    return scores(docs, train(docs, labels.where(~held), everyone=labels)).select("doc_id", held.alias("held_out"), "score", "predicted")
