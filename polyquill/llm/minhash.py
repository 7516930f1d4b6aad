"""Near-duplicate detection with b-bit MinHash.

A text's set holds its distinct 5-word shingles (64-bit hashes of lower-cased words; a shorter text is one
shingle).  Texts with the same set form a class, and only one text of the class, of its least doc_id, goes on.  Each class has
``PERMUTATIONS`` minima.  Bands of ``ROWS`` full minima find candidates; of every minimum only the low
``BITS`` bits are kept, packed into a signature, and counting equal low bits, corrected for chance
collisions, estimates the similarity of candidates.  Pairs that the estimate doesn't rule out by
``MARGIN`` standard errors are confirmed on the full sets.

Groups of any size: classes that share a band are joined to the band's least class, never to each other;
the components of these stars are the candidate groups.  A group is cut into blocks of ``BLOCK`` classes
and each pair of blocks is one task's unit of work, which returns a spanning forest of its links, so no
group meets in one task whole and no list of all pairs is made.  At a similarity of 0.85 a link is missed by all
bands with a probability under 1e-6, at 0.80 with one of 5e-5.

Defined results: a null, empty or blank text has no set and is linked with nothing; rows that share a doc_id
are linked by their own texts, and rows repeated whole are all marked kept (``one_of_each`` leaves one of them); a row with a null doc_id is linked
with nothing, has a null component_id and is kept; the order of equal candidates doesn't matter, as all are confirmed; other columns don't matter;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import components, cut, free_names
from .textkit import Hasher, chained, lower_ascii, mix, odd_constants, slices, space_words, utf8, windows, word_spans

SHINGLE, PERMUTATIONS, ROWS, BITS, BLOCK, MARGIN = 5, 125, 5, 2, 1024, 5.0


def shingle_sets(raw: np.ndarray, at: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    begin, end, first = word_spans(raw, at, space_words())
    h = hasher.spans(raw, begin, end)
    grams, gram_first = windows(h, first, SHINGLE, 5)
    out = []
    for i in range(len(first) - 1):
        n = first[i + 1] - first[i]
        if n >= SHINGLE:
            out.append(np.unique(grams[gram_first[i] : gram_first[i + 1]]))
        elif n:
            out.append(chained([h[j : j + 1] for j in range(first[i], first[i + 1])], 1000 + int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """(sets, permutations) least 32-bit values; no set may be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    k = odd_constants(2 * permutations, 11)
    out = np.empty((permutations, len(sets)), np.uint32)
    for i in range(permutations):
        out[i] = np.minimum.reduceat(_scramble(flat, np.uint32(int(k[2 * i]) >> 32 | 1), np.uint32(int(k[2 * i + 1]) >> 32)), starts)
    return out.T


def _scramble(x: np.ndarray, a: np.uint32, b: np.uint32) -> np.ndarray:
    y = x ^ b
    y *= a
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x2C1B3C6D)
    return y


def pack(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low bits of each minimum as bit planes: (sets, bits * bytes) uint8."""
    planes = [np.packbits((least >> np.uint32(j)) & np.uint32(1), axis=1) for j in range(bits)]
    return np.concatenate(planes, axis=1)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, permutations: int = PERMUTATIONS, bits: int = BITS) -> np.ndarray:
    """Collision-corrected similarity of packed signatures: (equal share - C) / (1 - C), C = 2**-bits for sparse sets."""
    x = (a ^ b).reshape(*np.broadcast(a, b).shape[:-1], bits, -1)
    differ = np.bitwise_count(np.bitwise_or.reduce(x, axis=-2)).sum(axis=-1)
    c = 2.0**-bits
    return ((1 - differ / permutations) - c) / (1 - c)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return tuple(int(x.astype(np.int64)) for x in a)


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for whole in batches:
        for batch in slices(whole):
            raw, at = utf8(batch.column("text"))
            sets = shingle_sets(lower_ascii(raw), at, hasher)
            digests = [_digest(s) for s in sets]
            new: dict[tuple, int] = {}
            for i, d in enumerate(digests):
                if len(sets[i]):
                    new.setdefault(d, i)
            bands: list = [None] * len(sets)
            sigs: list = [None] * len(sets)
            if new:
                least = minima([sets[i] for i in new.values()])
                packed = pack(least)
                groups = least.reshape(len(new), -1, ROWS).astype(np.uint64)
                k = odd_constants(ROWS, 21)
                keys = mix((groups * k).sum(axis=2, dtype=np.uint64) + np.arange(groups.shape[1], dtype=np.uint64) * k[0]).astype(np.int64)
                number = {d: j for j, d in enumerate(new)}
                for i, d in enumerate(digests):
                    if len(sets[i]):
                        bands[i], sigs[i] = keys[number[d]], packed[number[d]].tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()),
            ], ["doc_id", "text_hash", "n_shingles", "d1", "d2", "bands", "sig"])


class Forest:
    """Union-find with path halving."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = up
                return up
            up = nxt


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest_of_links(left: list[int], right: list[int], sets: list[np.ndarray], sigs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right (positions in sets), the same block if they are equal."""
    sizes, trees, out = np.array([len(s) for s in sets]), Forest(len(sets)), []
    c = 2.0**-BITS
    equal = c + (1 - c) * percent / 100  # share of equal low bits at the threshold
    se = MARGIN * np.sqrt(equal * (1 - equal) / PERMUTATIONS) / (1 - c)
    right_of = np.array(right, np.int64)
    for at, i in enumerate(left):
        others = right_of[at + 1 :] if left is right else right_of
        others = others[others != i]
        s, n = sizes[others], sizes[i]
        others = others[np.minimum(s, n) * 100 >= percent * np.maximum(s, n)]
        if not len(others):
            continue
        close = estimate(sigs[i], sigs[others], sizes[i], sizes[others]) >= percent / 100 - se
        for j in others[close]:
            a, b = trees.root(i), trees.root(int(j))
            if a != b and linked(sets[i], sets[j], percent):
                trees.up[b] = a
                out.append((i, int(j)))
    return out


def _confirm(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        hasher = Hasher()
        ids = table.column("node").to_pylist()
        part = table.column("part").to_pylist()
        sets: list[np.ndarray] = []
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for piece in slices(batch):
                raw, at = utf8(piece.column("text"))
                sets += shingle_sets(lower_ascii(raw), at, hasher)
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        left = [i for i, p in enumerate(part) if p == lo]
        right = left if lo == hi else [i for i, p in enumerate(part) if p == hi]
        pairs = forest_of_links(left, right, sets, sigs, percent)
        return pa.table({"a": pa.array([ids[i] for i, _ in pairs], pa.int64()), "b": pa.array([ids[j] for _, j in pairs], pa.int64())})

    return run


def _linked_classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows of docs (doc_id, text), their classes, and (node, root) of the classes that have links."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = cut(texts.mapInArrow(_sign, SIGNED))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("of")
    classes = signed.where("n_shingles > 0").groupBy("d1", "d2").agg(least, F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # classes are numbered, as two of them can have the same least doc_id
    classes = cut(classes.select("d1", "d2", F.col("of.doc_id").alias("rid"), "of.text_hash", "bands", "sig", F.monotonically_increasing_id().alias("node")))
    bands = classes.where("rid is not null").select("node", F.explode("bands").alias("band"))
    heads = bands.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head")
    stars = bands.join(heads, "band").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    groups = components(stars).select("node", F.col("root").alias("grp"))
    members = groups.join(classes.select("node", F.col("rid").alias("doc_id"), "text_hash", "sig"), "node")
    # blocks by a hash: as many as the group's size asks for
    sizes = groups.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = members.join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a text of the class itself, once, however often its row is repeated
    members = members.join(texts, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "node"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = members.select("grp", "node", "sig", "part", "text", other).select("grp", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "sig", "part", "text")
    links = units.groupBy("grp", "lo", "hi").applyInArrow(_confirm(percent), "a long, b long")
    return signed, classes, components(links)


def grouped(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text_hash, n_shingles, component_id and grp, a number of the component (null: no set)."""
    signed, classes, found = _linked_classes(docs, percent)
    ids = found.join(classes.select("node", "rid"), "node").groupBy("root").agg(F.min("rid").alias("component_id"))
    by_class = classes.select("d1", "d2", "rid", "node").join(found.join(ids, "root"), "node", "left")
    by_class = by_class.select("d1", "d2", F.coalesce("component_id", "rid").alias("component_id"), F.coalesce("root", "node").alias("grp"))
    own_id = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    with_set = signed.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "d1", "d2").join(by_class, ["d1", "d2"])
    own = with_set.select("doc_id", "text_hash", "n_shingles", own_id, "grp")
    without = signed.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("grp"))
    return own.unionByName(without)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per document of docs (doc_id, text): n_shingles, component_id (least doc_id reachable by links) and kept."""
    found = grouped(docs, percent).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs (doc_id, text, ...) but for all but one of each component; rows without a set or a doc_id stay."""
    signed, classes, found = _linked_classes(docs.where(F.col("doc_id").isNotNull()), percent)
    by_class = classes.select("d1", "d2", "node").join(found, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("grp"))
    with_set = signed.where("n_shingles > 0").select("doc_id", "text_hash", "d1", "d2").join(by_class, ["d1", "d2"])
    # stored, as it is read twice; the groups' least doc_id isn't needed here
    keys = cut(with_set.groupBy("grp", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    first = keys.groupBy("grp").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    _id, _hash, _nth = free_names(docs.columns, "_id", "_hash", "_nth")
    keys = keys.join(first, "grp").select(F.col("doc_id").alias(_id), F.col("text_hash").alias(_hash), "n", (F.struct("doc_id", "text_hash") == F.col("first")).alias("is_first"))
    keys = cut(keys.where("not is_first or n > 1").select(_id, _hash, "is_first"))
    same = (docs["doc_id"].cast("long") == F.col(_id)) & (F.xxhash64(docs["text"]) == F.col(_hash))
    # of equal keys the row with the least hash of all columns
    nth = F.row_number().over(Window.partitionBy(_id, _hash).orderBy(F.xxhash64(*(docs[c] for c in docs.columns))))
    again = docs.join(keys.where("is_first").select(_id, _hash), same).withColumn(_nth, nth).where(F.col(_nth) == 1)
    return docs.join(keys, same, "left_anti").unionByName(again.select(*docs.columns))
