"""Scores of texts by a trigram model kept as Elias-Fano tries (``eftrie``), one for each shard of contexts.

Texts are tokenised once into slices of some megabytes (a Parquet table in the shared folder): distinct words, and token numbers.  In two
exchanges each slice asks shards and gets answers:

1. for its distinct words, by hash of the word: count in the training texts and a word number;
2. for its distinct trigrams (u, v, w), by hash of v: the shard adds up the training counts of all slices, builds its trie, and
   answers each slice with codes of P(w | u v).

A slice sends an n-gram once however often it occurs, so a frequent word or passage is combined before it is shuffled.  A word v
that occurs more than ``CLASS_TOKENS`` times is divided by a hash of u into classes.  A context (u, v) lies whole in one class, which answers the
two terms of P(w | u v) = d(w | u v) + b(u v) P(w | v) apart; P(w | v) itself is learned from all pairs (v, w), which are divided
by a hash of w over the same shards and asked in the same exchange, and the slice puts the terms together.  So the division
doesn't change the model.  The number of shards follows the tokens, so a task's memory doesn't grow with the input, and nothing is
broadcast or collected but four totals.

Defined results: null and empty texts have the end token alone; a row whose doc_id is null is learned from; repeated rows are
scored alike, a row each; a text of any length is one text; an empty table gives no rows; without training texts every token has probability 1; other columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eftrie import DISCOUNT, Trie, probability, quantised
from .shared import shared_folder
from .textkit import Hasher, lower_ascii, mix, slices, space_words, trim, utf8, word_spans

SLICE, SHARD_TOKENS, CLASS_TOKENS = 6_000_000, 1_000_000, 1_500_000
#: Trigrams that a trie scores at once.
_STEP = 1 << 17
_END, _UNKNOWN, _START = np.uint64(0x5EED), 0, 1
_PARTS = "slice long, shard int, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; each integer's bytes lie in planes, so that small numbers compress well."""
    head = np.array([len(arrays)] + [n for a in arrays for n in (ord(a.dtype.kind), a.dtype.itemsize, len(a))], np.uint32)
    return zstandard.compress(head.tobytes() + b"".join(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays)), 3)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    at, out = 4 * (1 + 3 * n), []
    for kind, size, length in np.frombuffer(raw, np.uint32, 3 * n, 4).reshape(n, 3).tolist():
        planes = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).view(np.dtype(chr(kind) + str(size))).ravel())
        at += size * length
    return out


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and each item's number."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    s, k, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(k, pa.int32()), pa.array(b, pa.binary())], ["slice", "shard", "blob"])


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Runs of equal values of a sorted column, with the rows' other number and blob; a run may span batches."""
    other, now, rows = ("slice" if column == "shard" else "shard"), None, []
    for b in batches:
        for key, o, blob in zip(b.column(column).to_pylist(), b.column(other).to_pylist(), b.column("blob")):
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append((o, blob.as_py()))
    if rows:
        yield now, rows


def _exchange(df: DataFrame, column: str, parts: int, f: Callable, schema: str = _PARTS) -> DataFrame:
    other = "slice" if column == "shard" else "shard"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches, column):
            yield from f(key, rows)
            del rows
            trim()

    return df.repartition(parts, column).sortWithinPartitions(column, other).mapInArrow(run, schema)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, number = Hasher(), TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, most=SLICE):
            raw, at = utf8(batch.column("text"))
            raw = lower_ascii(raw)
            begin, end, first = word_spans(raw, at, space_words())
            h = np.insert(hasher.spans(raw, begin, end), first[1:], _END)
            words, _, token = _distinct(h)
            size = np.diff(first) + 1
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            ids = batch.column("doc_id")
            missing = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0), np.int64)
            c = np.bincount(token, np.repeat(~held, size), len(words)).astype(np.uint32)
            often = np.argsort(-np.bincount(token, minlength=len(words)), kind="stable")  # frequent words get small numbers
            place = np.empty(len(words), np.int64)
            place[often] = np.arange(len(words))
            token = place[token]
            narrow = np.uint16 if len(words) <= 1 << 16 else np.uint32
            blob = _pack(ids, missing, held, size.astype(np.uint32), often.astype(narrow), token.astype(narrow))
            n = int(size.sum())
            columns = [pa.array([number]), pa.array([-1], pa.int32()), pa.array([blob], pa.binary()), pa.array([_pack(words, c)], pa.binary()), pa.array([n]), pa.array([int(size[~held].sum())])]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "shard", "blob", "words", "tokens", "learned"])
            number += 1
            del raw, begin, end, h, words, token, often, place
            trim()


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so a slice's sorted words lie in the order of their shards."""
    return (((words >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _ask_words(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, blob in zip(b.column("slice").to_pylist(), b.column("blob")):
                words, c = _unpack(blob.as_py())
                ks, at = np.unique(_word_shard(words, shards), return_index=True)
                yield _rows([(s, int(k), _pack(np.diff(words[x:y], prepend=np.uint64(0)), c[x:y])) for k, x, y in zip(ks, at, [*at[1:], len(words)])])

    return run


def _answer_words(shards: int) -> Callable:
    def f(shard: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        asked = [_unpack(b) for _, b in rows]
        words, _, back = _distinct(np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked]))
        c = np.bincount(back, np.concatenate([a[1] for a in asked])).astype(np.int64)
        number = np.empty(len(c), np.int64)
        number[np.argsort(-c, kind="stable")] = 2 + shard + shards * np.arange(len(c))  # frequent words get small numbers
        number[c == 0] = _UNKNOWN
        at, kinds = 0, int((c > 0).sum())
        for (s, _), a in zip(rows, asked):
            i = back[at : at + len(a[0])]
            at += len(i)
            b = _rows([(s, shard, _pack(c[i], number[i].astype(np.uint32)))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([kinds])], ["slice", "shard", "blob", "kinds"])
            kinds = 0

    return f


class _Slice:
    """A slice with the answers of the word shards: its distinct trigrams in the order of its questions."""

    def __init__(self, blob: bytes, answers: list[bytes], shards: int, total: int, kinds: int, class_tokens: int = CLASS_TOKENS) -> None:
        self.ids, self.missing, self.held, size, often, token = _unpack(blob)
        count, number = (np.concatenate(x).astype(np.int64)[often] for x in zip(*map(_unpack, answers)))  # answers lie in the order of the hashes
        self.size, self.first = size.astype(np.int64), np.concatenate([[0], np.cumsum(size[:-1], dtype=np.int64)])
        log = np.log10((count + 0.5) / (total + 0.5 * (kinds + 1))) if total else np.zeros(len(count))
        self.base = np.add.reduceat(log[token], self.first)
        self.known = np.add.reduceat((count > 0)[token].astype(np.int64), self.first)

        # unknown words are one word; the last number is that of a text's start
        words, one, same = _distinct(number)
        words, log, count = np.append(words, _START), np.append(log[one], 0), np.append(count[one], 0)
        n, start = len(words), len(words) - 1
        w = same[token]
        v = np.concatenate([[start], w[:-1]])
        v[self.first] = start
        u = np.concatenate([[start], v[:-1]])
        u[self.first] = start

        # contexts v, with their classes of u (and of w), in the order of their shards
        pieces = 1 + count // class_tokens
        begin = np.cumsum(pieces) - pieces
        of = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(of)) - begin[of]
        home = (mix(words[of].astype(np.uint64) + (nth.astype(np.uint64) << np.uint64(40))) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        place = np.empty(len(of), np.int64)
        place[order] = np.arange(len(of))
        scrambled = mix(words.astype(np.uint64))
        class_of = lambda v, x: place[begin[v] + (scrambled[x] % pieces[v].astype(np.uint64)).astype(np.int64)]
        context = class_of(v, u)

        bits = n.bit_length()
        if len(of).bit_length() + 2 * bits > 62:  # only in slices of one immense text
            pair, _, number2 = _distinct((context << bits) | w)
            triple, _, self.entry = _distinct((number2 << bits) | u)
            which, u3 = triple >> bits, triple & ((1 << bits) - 1)
        else:
            triple, _, self.entry = _distinct((context << 2 * bits) | (w << bits) | u)
            high, u3 = triple >> bits, triple & ((1 << bits) - 1)
            which = np.cumsum(np.concatenate([[0], high[1:] != high[:-1]]))
            pair = high[np.concatenate([[True], high[1:] != high[:-1]])]
        at, w2 = order[pair >> bits], pair & ((1 << bits) - 1)
        shard2 = home[at]
        self.shard3 = shard2[which]
        narrow = lambda x: x.astype(np.uint32)
        self.triples = [narrow(words[u3]), narrow(np.bincount(self.entry, np.repeat(~self.held, size), len(triple)))]
        # classes of a word that share a shard stay apart by their number, from 1; 0 is a word that isn't divided
        nth = np.where(pieces[of] > 1, nth + 1, 0)
        self.pairs = shard2, [narrow(words[of[at]]), narrow(nth[at]), narrow(words[w2]), narrow(np.bincount(which))]
        self.codes = quantised(10.0**log)[w2]

        # pairs (v, w) of divided words, in the order of the classes of w; every class of these v is asked, for its number of kinds
        divided = np.flatnonzero(nth[at])
        v2 = of[at[divided]]
        asked, one, back = _distinct((class_of(v2, w2[divided]) << bits) | w2[divided])
        mine = np.zeros(n, bool)
        mine[v2] = True
        classes = np.flatnonzero(mine[of[order]])
        runs = np.bincount(np.searchsorted(classes, asked >> bits), minlength=len(classes))
        self.class_shard = home[order[classes]]
        self.classes = [narrow(words[of[order[classes]]]), narrow(nth[order[classes]]), count[of[order[classes]]], narrow(runs)]
        self.first_pair = np.concatenate([[0], np.cumsum(runs)])
        c2 = np.bincount(which, self.triples[1], len(pair))
        self.divided_pairs = [narrow(words[asked & ((1 << bits) - 1)]), narrow(np.bincount(back, c2[divided], len(asked)))]
        # what puts the terms together: a divided triple's place, its context (u, v) and its pair; a pair's word v and P(w)
        pair_number = np.full(len(pair), -1)
        pair_number[divided] = back
        self.divided = np.flatnonzero(pair_number[which] >= 0)
        self.divided_pair = pair_number[which[self.divided]]
        self.divided_context = _distinct(((pair >> bits)[which[self.divided]] << 32) | words[u3[self.divided]])[2]
        self.class_word, self.pair_word = of[order[classes]], v2[one]
        self.pair_base, self.word_count = 10.0 ** log[w2[divided][one]], count

    def questions(self) -> Iterator[tuple[int, bytes]]:
        shard2, pairs = self.pairs
        for k in np.union1d(shard2, self.class_shard):
            a, b = np.searchsorted(shard2, [k, k + 1])
            c, d = np.searchsorted(self.shard3, [k, k + 1])
            v, nth, w, runs = (x[a:b] for x in pairs)
            words, one, _ = _distinct(w)
            e, f = np.searchsorted(self.class_shard, [k, k + 1])
            g, h = self.first_pair[[e, f]]
            more = [*(x[e:f] for x in self.classes), *(x[g:h] for x in self.divided_pairs)] if e < f else []
            yield int(k), _pack(np.diff(v, prepend=v[:1] * 0), nth, w, runs, self.codes[a:b][one], *(x[c:d] for x in self.triples), *more)

    def results(self, answers: list[bytes]) -> list[np.ndarray]:
        parts = [_unpack(a) for a in answers]
        p = np.concatenate([probability(a[0]) for a in parts])
        if len(self.divided):
            back3, p2 = (probability(np.concatenate([a[i] for a in parts if len(a) > 1])) for i in (1, 2))
            kinds = np.bincount(self.class_word, np.concatenate([a[3] for a in parts if len(a) > 1]), len(self.word_count))
            p2 += DISCOUNT * (kinds / np.maximum(self.word_count, 1))[self.pair_word] * self.pair_base
            p[self.divided] += back3[self.divided_context] * p2[self.divided_pair]
        logs = np.log10(p)
        add = lambda x: np.add.reduceat(x, self.first)
        return [self.size, self.known, self.base, add(logs[self.entry])]


def _answer_trigrams(shard: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Codes for each slice's trigrams.  Arrays go as soon as they have served, since a shard's questions are the most that a task holds."""
    asked = [_unpack(b) for _, b in rows]
    for a in asked:
        a[0] = np.cumsum(a[0], dtype=np.uint32)
        a[4] = a[4][_distinct(a[2])[2]]
    sizes = [len(a[5]) for a in asked]
    more = _answer_pairs([a[7:] for a in asked])
    joined = lambda i: np.concatenate([a[i] for a in asked])
    v, nth, w, runs, code, u3, c3 = map(joined, range(7))
    slices_ = [s for s, _ in rows]
    rows.clear()
    del asked
    whole = nth == 0
    _, _, context = _distinct((v.astype(np.uint64) << np.uint64(32)) | nth)
    del v, nth
    context = context.astype(np.uint32)
    pair, one, of = _distinct((context.astype(np.uint64) << np.uint64(32)) | w)
    v2, w2, divided = context[one].astype(np.int64), w[one], ~whole[one]
    base = np.where(divided, 0, probability(code[one]))  # a divided word's answers are without P(w | v)
    n_pairs = len(pair)
    of = np.repeat(of.astype(np.uint32), runs)
    asked_context, asked_whole = (np.repeat(context, runs), np.repeat(whole, runs)) if any(more) else (None, None)
    del pair, one, code, w, context, whole, runs
    triple, _, back = _distinct((of.astype(np.int64) << 32) | u3)
    del of
    back = back.astype(np.uint32)
    c3 = np.bincount(back, c3, len(triple)).astype(np.uint32)
    asked_u = u3 if any(more) else None
    b3, u3 = (triple >> 32).astype(np.uint32), (triple & 0xFFFFFFFF).astype(np.uint32)
    del triple
    c2 = np.bincount(b3, c3, n_pairs)
    seen, dense = c2 > 0, np.cumsum(c2 > 0) - 1
    full = c3 > 0
    trie = Trie(Trie.build(v2[seen], w2[seen], c2[seen], base[seen], dense[b3[full]], u3[full], c3[full], divided[seen]))
    del full, c3, c2, dense, seen
    trim()
    codes = np.empty(len(u3), np.uint16)
    for x in range(0, len(u3), _STEP):
        b = b3[x : x + _STEP]
        codes[x : x + _STEP] = quantised(trie.score(u3[x : x + _STEP], v2[b], w2[b], base[b]))
    del u3, b3
    codes = codes[back]
    at = 0
    for s, n, m in zip(slices_, sizes, more):
        if m:
            mine = at + np.flatnonzero(~asked_whole[at : at + n])
            contexts, _, _ = _distinct((asked_context[mine].astype(np.int64) << 32) | asked_u[mine])
            m = [quantised(trie.back(contexts & 0xFFFFFFFF, contexts >> 32)), *m]
        yield _rows([(s, shard, _pack(codes[at : at + n], *m))])
        at += n


def _answer_pairs(asked: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """For each question about pairs (v, w) of divided words: codes of the discounted share of each pair, and the kinds of w in each class."""
    some = [a for a in asked if a]
    if not some:
        return [[] for _ in asked]
    v, nth, total, runs, w, c = (np.concatenate([a[i] for a in some]) for i in range(6))
    classes, one, of = _distinct((v.astype(np.uint64) << np.uint64(32)) | nth)
    pair, _, back = _distinct((np.repeat(of, runs) << 32) | w)
    c2 = np.bincount(back, c, len(pair))
    codes = quantised(np.maximum(c2 - DISCOUNT, 0) / np.maximum(total[one][pair >> 32], 1))[back]
    kinds = np.bincount(pair >> 32, c2 > 0, len(classes)).astype(np.uint32)[of]
    out, i, j = [], 0, 0
    for a in asked:
        m, n = (len(a[0]), len(a[4])) if a else (0, 0)
        out.append([codes[j : j + n], kinds[i : i + m]] if a else [])
        i, j = i + m, j + n
    return out


def score(docs: DataFrame, shard_tokens: int = SHARD_TOKENS, class_tokens: int = CLASS_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")).mapInArrow(_sliced, _PARTS + ", words binary, tokens long, learned long").write.parquet(f"{folder}/slices")
    cut = spark.read.parquet(f"{folder}/slices")
    tokens, total = cut.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("learned"), F.lit(0))).first()
    shards = max(1, -(-tokens // shard_tokens))
    word_shards = max(1, shards // 4)
    words = cut.select("slice", "shard", F.col("words").alias("blob"))
    cut = cut.select("slice", "shard", "blob")

    _exchange(words.mapInArrow(_ask_words(word_shards), _PARTS), "shard", word_shards, _answer_words(word_shards), _PARTS + ", kinds long").write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    kinds = words.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    known = cut.unionByName(words.select("slice", "shard", "blob"))

    def ask(s: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        one = _Slice(rows[0][1], [b for _, b in rows[1:]], shards, total, kinds, class_tokens)
        yield from (_rows([(s, k, b)]) for k, b in one.questions())

    def finish(s: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        mine = [b for k, b in rows if k < word_shards]
        one = _Slice(mine[0], mine[1:], shards, total, kinds, class_tokens)
        size, n_known, base, logs = one.results([b for k, b in rows if k >= word_shards])
        ids = pa.array(one.ids, mask=one.missing)
        columns = [ids, pa.array(one.held), pa.array(size), pa.array(n_known), pa.array(np.full(len(size), total, np.int64)), pa.array(base), pa.array(logs)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    trigrams = _exchange(_exchange(known, "slice", shards, ask), "shard", shards, _answer_trigrams)
    answered = trigrams.withColumn("shard", F.col("shard") + word_shards)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _exchange(known.unionByName(answered), "slice", shards, finish, schema)
