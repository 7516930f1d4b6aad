"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash is computed for all positions at once by doubling; its low ``HISTORY`` bits depend on as many bytes.  A chunk ends at each
place whose hash is the least of some ``WINDOW`` successive places, the first if several are (winnowing), so a border depends on the bytes
near it alone.  Two places of a passage of n bytes have the same borders, and so the same chunks, in all but at most
HISTORY - 1 + 2 * (WINDOW - 1) of its bytes: every passage of 265 bytes has a run of ``RUN_BYTES``, also in periodic text, whose chunks are whole periods.  Chunks are
counted by a 96-bit digest; the least doc_id with it owns it, there the first place.  A run of successive chunks that
all occur elsewhere and has at least ``RUN_BYTES`` bytes is a repeated passage; in it, the chunks owned by another place are surplus.

Digests with at least a ``1 / HOT_PARTS`` share of all chunks number at most ``HOT_PARTS`` (20000), so they are broadcast; all other digests
have less than that share and are joined by shuffle.

Defined results: a null or empty text has no chunks and all counts 0; rows that repeat a doc_id count as
more places of one document; a row with a null doc_id is a document of its own by its text's hash (rows with one text are one), which owns a chunk only where no
doc_id does and isn't listed as an owner (doc_ids must be under 2**62); of places with one digest the least doc_id, there the first, owns it; an empty table gives no rows; other
columns don't matter to ``report`` and stay in ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import HOT_PARTS, cut, free_names
from .textkit import Hasher, mix, slices, utf8

HISTORY, WINDOW, MOST, RUN_BYTES = 20, 64, 512, 120  # WINDOW is a power of two

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 * h + G[byte] (mod 2**32) at every byte, anew in each text."""
    h = _GEAR[raw]
    place = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
    for k in (1, 2, 4, 8, 16):
        back = np.zeros_like(h)
        back[k:] = h[:-k] << np.uint32(k) if len(h) > k else back[k:]
        h = h + np.where(place >= k, back, np.uint32(0))
    return h


def borders(raw: np.ndarray, at: np.ndarray, window: int = WINDOW, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends of all texts, and each text's number of chunks."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    least = ((gear(raw, at) << np.uint32(32 - HISTORY)).astype(np.uint64) << np.uint64(32)) | np.arange(len(raw), dtype=np.uint64)
    k = 1
    while k < window:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = least[doc[: len(least)] == doc[window - 1 :]]  # windows inside one text
    least = least[np.diff(least, prepend=np.uint64(2**64 - 1)) != 0]
    place, value = (least & np.uint64(0xFFFFFFFF)).astype(np.int64), least >> np.uint64(32)
    # in a periodic stretch, whose least hashes are equal, a border only after so many periods as make half a window
    gap = np.diff(place, prepend=0)
    new = np.ones(len(place), bool)
    new[1:] = (value[1:] != value[:-1]) | (gap[1:] >= window) | (np.diff(doc[place]) != 0)
    since = np.arange(len(place)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    ends = np.union1d(place[new | (since % -(-window // 2 // np.maximum(gap, 1)) == 0)] + 1, at[1:][np.diff(at) > 0]).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])[: len(ends)]
    cuts = (ends - begins - 1) // most
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts) + 1
    ends = np.sort(np.concatenate([ends, np.repeat(begins, cuts) + most * nth]))
    return ends, np.bincount(doc[ends - 1], minlength=len(at) - 1)


_NO_ID = 1 << 62


def _key(docs: DataFrame) -> Column:
    """The doc_id, or a number over all doc_ids made of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID).bitwiseOR(F.xxhash64("text").bitwiseAND(_NO_ID - 1)))


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, place (nth in the high 32 bits, first byte in the low), size (bytes) and the digest d1, d2 of every chunk of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for whole in batches:
            for batch in slices(whole, most=500_000):
                raw, at = utf8(batch.column("text"))
                ends, counts = borders(raw, at)
                first = np.concatenate([[0], np.cumsum(counts)])
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                h = hasher.spans(raw, begins, ends)
                h2 = hasher.spans(raw, begins, ends, seed=1)
                doc = np.repeat(np.arange(batch.num_rows), counts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(doc)), pa.array(((np.arange(len(ends)) - first[doc]) << 32) | (begins - at[doc])), pa.array((ends - begins).astype(np.int32)), pa.array(h.astype(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                ], ["doc_id", "place", "size", "d1", "d2"])

    return docs.select(_key(docs).alias("doc_id"), "text").mapInArrow(run, "doc_id long, place long, size int, d1 long, d2 int")


def repeated(docs: DataFrame) -> DataFrame:
    """Chunks in repeated passages: doc_id, nth, at, size, owner (first doc_id), surplus."""
    chunks = cut(chunked(docs))
    keys = chunks.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).where("n > 1")  # both combine in hash maps before the shuffle
    keys = cut(keys)
    total = chunks.count()
    hot = keys.where(F.col("n") * HOT_PARTS >= total).drop("n")  # at most HOT_PARTS rows
    rest = keys.where(F.col("n") * HOT_PARTS < total).drop("n")
    by_hot = chunks.join(F.broadcast(hot), ["d1", "d2"])
    by_rest = chunks.join(F.broadcast(hot.select("d1", "d2")), ["d1", "d2"], "left_anti").join(rest.hint("merge"), ["d1", "d2"])
    found = by_hot.unionByName(by_rest)
    w = Window.partitionBy("doc_id").orderBy("place")
    nth = F.shiftright("place", 32).cast("int")
    island = nth - F.dense_rank().over(w)
    found = found.withColumn("island", island)
    size = F.sum("size").over(Window.partitionBy("doc_id", "island"))
    again = F.row_number().over(Window.partitionBy("doc_id", "d1", "d2").orderBy("place")) > 1
    surplus = (F.col("doc_id") != F.col("owner")) | again
    found = found.withColumn("surplus", surplus)
    return found.withColumn("run", size).where(F.col("run") >= RUN_BYTES).select("doc_id", nth.alias("nth"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("at"), "size", "owner", "surplus")


def report(docs: DataFrame) -> DataFrame:
    """Per document: its bytes, bytes in repeated passages and surplus bytes, and the first doc_ids of its surplus chunks."""
    found = repeated(docs)
    elsewhere = F.col("surplus") & (F.col("owner") != F.col("doc_id")) & (F.col("owner") < _NO_ID)
    by_doc = found.groupBy(F.col("doc_id").alias("key")).agg(
        F.count("*").alias("n_repeated"), F.sum("size").alias("repeated_bytes"), F.sum(F.when(F.col("surplus"), F.col("size")).otherwise(0)).alias("surplus_bytes"),
        F.array_sort(F.collect_set(F.when(elsewhere, F.col("owner")))).alias("owners"),
    )
    size = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(docs).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return size.join(by_doc, "key", "left").select("doc_id", "n_bytes", zero("n_repeated"), zero("repeated_bytes"), zero("surplus_bytes"), F.coalesce("owners", F.array().cast("array<long>")).alias("owners"), (F.coalesce("repeated_bytes", F.lit(0)) > 0).alias("has_repeats"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the surplus chunks of repeated passages cut out of their texts; doc_ids must be unique.  A text's cuts number no more than its chunks."""
    key, cuts = free_names(docs.columns, "_key", "_cuts")
    surplus = repeated(docs).where("surplus").groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias(cuts))
    joined = docs.withColumn(key, _key(docs)).join(surplus, key, "left").drop(key)
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, gone in enumerate(b.column(cuts).to_pylist()):
                if gone:
                    raw, parts, at = texts[i].encode(), [], 0
                    for c in gone:
                        parts.append(raw[at : c["at"]])
                        at = c["at"] + c["size"]
                    texts[i] = b"".join([*parts, raw[at:]]).decode("utf-8", "ignore")  # a chunk may end inside a character
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names)

    return joined.mapInArrow(run, docs.schema)
