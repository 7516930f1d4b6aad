"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows: each run of ``window`` consecutive item words, or a shorter item whole.
Patterns of one length share a block shift table: a block is the last two words (one, for patterns of a single
word) of the search window, and the table tells by how many words the search may move on.  Where the shift is
zero, the block's hash selects a bucket of patterns; those whose word hashes agree are compared with the text directly, byte by byte.

The search runs in lanes: texts are cut into overlapping runs of words and numpy moves all lanes of a batch
at once, each by its own shift.  No rows are shuffled.  The patterns are broadcast in blocks of at most
``BLOCK_BYTES`` of benchmark text; a larger benchmark takes more passes over the documents, never a larger
broadcast, and what a pass has found is stored before the next, so that a task holds one block's tables however many there are.

Defined results: a null or empty text has no words (n_words 0, not contaminated); a null or empty item
has no windows; items that share an item_id count once, and a null item_id is the empty string; repeated documents, and rows with a null
doc_id, give a row each; texts of any length are searched whole; an empty benchmark hits nothing, empty documents give no rows; other columns of documents stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, free_names, shipped
from .textkit import Hasher, alnum_words, eights, lower_ascii, odd_constants, same_bytes, slices, utf8, word_spans

WINDOW = 10
#: Benchmark text, in bytes, that one pass broadcasts.
BLOCK_BYTES = 8_000_000
#: Words a lane starts with; the shift tables have 2**TABLE_BITS entries.
LANE, TABLE_BITS = 256, 18


class ShiftTables:
    """Wu-Manber tables of equally long patterns: ``patterns`` is an array (number, length) of word hashes; the words themselves are ranges of raw."""

    def __init__(self, patterns: np.ndarray, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        self.patterns, self.m = patterns, patterns.shape[1]
        self.raw, self.begin, self.size = raw, begin, size
        self.eights = None  # made where the search runs
        self.b = min(2, self.m)
        self.k = odd_constants(2, 77)
        self.shift = np.full(1 << TABLE_BITS, self.m - self.b + 1, np.int64)
        for j in range(self.m - self.b + 1):  # a block that ends j words before the pattern's end allows a shift of j
            at = self.m - self.b - j
            np.minimum.at(self.shift, self._slot(self._block(patterns, at)), j)
        suffix = self._block(patterns, self.m - self.b)
        order = np.argsort(suffix, kind="stable")
        self.order, self.suffix = order, suffix[order]

    def _block(self, words: np.ndarray, at: int) -> np.ndarray:
        return words[:, at] * self.k[0] + (words[:, at + 1] * self.k[1] if self.b == 2 else np.uint64(0))

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, h: np.ndarray, first: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence in texts of words h, which are ranges of raw, text i being h[first[i]:first[i + 1]]: its first word, and the pattern."""
        m, b = self.m, self.b
        n = np.diff(first)
        starts = np.maximum(n - m + 1, 0)  # windows of each text
        lanes = -(-starts // LANE)
        of = np.repeat(np.arange(len(n)), lanes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = first[:-1][of] + nth * LANE
        last = np.minimum(pos + LANE, first[:-1][of] + starts[of])
        found_at, found = [], []
        block = h * self.k[0] if b == 1 else h[:-1] * self.k[0] + h[1:] * self.k[1] if len(h) > 1 else h[:0]
        while len(pos):
            key = block[pos + m - b]
            step = self.shift[self._slot(key)]
            zero = np.flatnonzero(step == 0)
            if len(zero):
                lo, hi = np.searchsorted(self.suffix, key[zero], "left"), np.searchsorted(self.suffix, key[zero], "right")
                count = hi - lo
                where = np.repeat(pos[zero], count)
                which = self.order[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
                equal = np.ones(len(where), bool)
                for j in range(m):
                    equal[equal] = h[where[equal] + j] == self.patterns[which[equal], j]
                found_at.append(where[equal])
                found.append(which[equal])
            pos = pos + np.maximum(step, 1)
            keep = pos < last
            pos, last = pos[keep], last[keep]
        where, which = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_at, found))
        if len(where):
            own = eights(raw)
            if self.eights is None:
                self.eights = eights(self.raw)
            for j in range(m):
                at = begin[where + j]
                equal = same_bytes(own, at, end[where + j] - at, self.eights, self.begin[which, j], self.size[which, j])
                where, which = where[equal], which[equal]
        return where, which


def patterns(ids: list, texts: list, window: int = WINDOW) -> list[tuple[ShiftTables, list[list[int]]]]:
    """Tables for each pattern length, with the numbers of the items that have each pattern."""
    raw, at = utf8(pa.array(texts, pa.string()))
    raw = lower_ascii(raw)
    begin, end, first = word_spans(raw, at, alnum_words())
    h = Hasher().spans(raw, begin, end)
    by_length: dict[int, dict[bytes, tuple[int, set[int]]]] = {}
    for i in range(len(ids)):
        m = min(window, int(first[i + 1] - first[i]))
        for j in range(first[i], first[i + 1] - m + 1 if m else first[i]):
            words = b" ".join(raw[a:b].tobytes() for a, b in zip(begin[j : j + m], end[j : j + m]))  # no word has a space
            by_length.setdefault(m, {}).setdefault(words, (int(j), set()))[1].add(i)
    out = []
    for m, windows in sorted(by_length.items()):
        at = np.array([j for j, _ in windows.values()])[:, None] + np.arange(m)
        out.append((ShiftTables(h[at], raw, begin[at], end[at] - begin[at]), [sorted(x) for _, x in windows.values()]))
    return out


def _pass(tables: Callable, names: list[str], column: str, out: list[str]):
    """Adds, per row, the hit words (as a bit string) and the items of one block of the benchmark to those before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, words = Hasher(), alnum_words()
        searches, items_of = tables()
        for whole in batches:
            for batch in slices(whole, column):
                raw, at = utf8(batch.column(column))
                raw = lower_ascii(raw)
                begin, end, first = word_spans(raw, at, words)
                h = hasher.spans(raw, begin, end)
                delta = np.zeros(len(h) + 1, np.int32)
                items: dict[int, set[str]] = {}
                for search, owners in searches:
                    pos, which = search.search(h, first, raw, begin, end)
                    np.add.at(delta, pos, 1)
                    np.add.at(delta, pos + search.m, -1)
                    found = np.unique(((np.searchsorted(first, pos, "right") - 1) << 32) | which)
                    for doc, p in zip((found >> 32).tolist(), (found & 0xFFFFFFFF).tolist()):
                        items.setdefault(doc, set()).update(items_of[i] for i in owners[p])
                hit = np.cumsum(delta[:-1]) > 0
                old_hits, old_items = batch.column(out[0]).to_pylist(), batch.column(out[1]).to_pylist()
                marked = np.concatenate([[0], np.cumsum(hit)])
                touched = marked[first[1:]] > marked[first[:-1]]
                bits, lists = [], []
                for i in range(batch.num_rows):
                    if not touched[i]:
                        bits.append(old_hits[i])
                        lists.append(old_items[i] or [])
                        continue
                    own = hit[first[i] : first[i + 1]]
                    if old_hits[i] is not None:
                        own = own | np.unpackbits(np.frombuffer(old_hits[i], np.uint8), count=own.size).astype(bool)
                    bits.append(np.packbits(own).tobytes())
                    lists.append(sorted(items.get(i, set()) | set(old_items[i] or ())))
                columns = [batch.column(c) for c in names]
                columns += [pa.array(bits, pa.binary()), pa.array(lists, pa.list_(pa.string())), pa.array(np.diff(first), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, *out])

    return run


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names (new ones, whatever docs has): a bit string of hit words (null if none),
    the items with occurring windows (ids as strings, sorted) and the number of words."""
    spark = docs.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    names = list(docs.columns)
    added = free_names(names, "_hits", "_items", "_words")
    out = docs.withColumns({added[0]: F.lit(None).cast("binary"), added[1]: F.lit(None).cast("array<string>"), added[2]: F.lit(0).cast("long")})
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.BinaryType()), T.StructField(added[1], T.ArrayType(T.StringType())), T.StructField(added[2], T.LongType())])
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        if k:
            out = cut(out)
        rows = benchmark.where(block == k).select(F.col("item_id").cast("string").alias("item_id"), "text").collect()  # about BLOCK_BYTES of text
        ids = [r[0] or "" for r in rows]
        out = out.mapInArrow(_pass(shipped(spark, (patterns(ids, [r[1] for r in rows], window), ids)), names, text, added), schema)
    return out, added


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and items (the ids)."""
    found, (marks, items, words) = hits(docs.select("doc_id", "text"), benchmark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [0 if x is None else int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in b.column(marks).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(words), b.column(items), pa.array(n, pa.int64())], ["doc_id", "n_words", "items", "n_hit"])

    counted = found.select("doc_id", words, items, marks).mapInArrow(count, T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_hit", T.LongType())]))
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )
