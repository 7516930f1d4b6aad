"""Best-fit packing of documents into sequences by bin completion.

A document is its token ids and an end id.  Only documents longer than a sequence are cut, into pieces of full length
and a rest.  What matters for packing is how many pieces each length has: that histogram has at most ``capacity``
rows whatever the corpus, so the search runs on it.

The incumbent is best-fit decreasing on the histogram.  If it isn't at the lower bound (``least_bins``),
branch and bound completes bins around the largest length left: it enumerates undominated fillings (maximal ones in
which no piece, and no pair, can give way to one larger piece), tries those of least waste first, takes each as many
times as the counts allow, and cuts a branch whose waste exceeds what a better solution than the incumbent may waste.
``NODES`` and ``FILLINGS`` bound the search, never the pieces: what the search leaves is completed by best fit.

The solution is a list of (filling, times).  Pieces of a length are numbered in the cluster (counts per salted
bucket, then a number within the bucket) and look up their sequence by number.  The driver sees only the histogram.

Defined results: a null or empty text is one piece, its end id; repeated rows, and rows with a null doc_id, are packed each; a text of any length is cut into as many pieces as it needs; of equally good fillings
the first in order counts, and which of equally long pieces goes where follows their doc_id, piece and checksum; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .textkit import slices
from .wordids import WordIds

CAPACITY, END_ID, NODES, FILLINGS = 4096, 1, 4000, 4
#: Pieces numbered together, about.
BUCKET = 200


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(model.value)
        for whole in batches:
            for batch in slices(whole, most=1_000_000):
                ids, first = words.encode(batch.column("text"), end_id)
                ids = ids.astype("<u4")
                size = np.diff(first)
                count = -(-size // capacity)
                row = np.repeat(np.arange(batch.num_rows), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                begin = first[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Counts:
    """How many pieces of each length are left, with the next length at or below a given one."""

    def __init__(self, left: np.ndarray) -> None:
        self.left = left.copy()

    def below(self, most: int) -> int:
        """The largest length left of at most ``most``; 0 if none."""
        if most <= 0:
            return 0
        at = np.flatnonzero(self.left[: most + 1])
        return int(at[-1]) if len(at) and at[-1] else 0

    def times(self, filling: tuple[int, ...]) -> int:
        lengths, need = np.unique(filling, return_counts=True)
        return int((self.left[lengths] // need).min())

    def take(self, filling: tuple[int, ...], times: int) -> None:
        np.subtract.at(self.left, list(filling), times)

    def filled(self, largest: int, capacity: int) -> tuple[int, ...]:
        """The best-fit filling around a piece: then always the largest left that still fits."""
        filling, room = [largest], capacity - largest
        self.left[largest] -= 1
        while nxt := self.below(room):
            n = min(int(self.left[nxt]), room // nxt)
            filling += [nxt] * n
            room -= n * nxt
            self.left[nxt] -= n
        self.take(tuple(filling), -1)
        return tuple(filling)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, bin by bin: the largest piece, then always the largest that still fits."""
    c, out = Counts(left), []
    while largest := c.below(capacity):
        filling = c.filled(largest, capacity)
        times = c.times(filling)
        c.take(filling, times)
        out.append((filling, times))
    return out


def dominated(filling: tuple[int, ...], waste: int, c: Counts) -> bool:
    """Whether one larger piece that is left can take the place of a piece or a pair (or of nothing) within the waste."""
    rest = filling[1:]
    c.take(filling, 1)
    spots = {0, *rest, *(a + b for i, a in enumerate(rest) for b in rest[i + 1 :])} if len(rest) <= 12 else {0, *rest}
    worse = any(c.below(s + waste) > s or (s not in rest and 0 < s <= len(c.left) - 1 and c.left[s] > 0) for s in spots)
    c.take(filling, -1)
    return worse


def fillings(c: Counts, largest: int, capacity: int, most: int = FILLINGS, steps: int = 300) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, filling) of undominated fillings around the largest piece, the least waste first; one at least.

    The search first goes down to the best-fit filling, a step a piece.  Where that filling has more pieces than half the steps, all but so many of its last ones are set, so the search always comes to its end."""
    found: dict[tuple[int, ...], int] = {}
    budget = [steps]

    def extend(filling: list[int], room: int, top: int) -> None:
        if len([w for w in found.values() if w == 0]) >= most or budget[0] <= 0:
            return
        budget[0] -= 1
        size = c.below(min(room, top))
        if not size:
            found.setdefault(tuple(filling), room)
            return
        tried = 0
        while size and tried < 6:
            c.left[size] -= 1
            extend([*filling, size], room - size, size)
            c.left[size] += 1
            size, tried = c.below(size - 1), tried + 1

    whole = c.filled(largest, capacity)
    head = whole[: max(1, len(whole) - steps // 2)]
    c.take(head, 1)
    extend([*head], capacity - sum(head), head[-1])
    c.take(head, -1)
    ordered = sorted((w, f) for f, w in found.items())
    kept = [x for x in ordered[: 4 * most] if not dominated(x[1], x[0], c)]
    return (kept or ordered)[:most]


def least_bins(left: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of bins: the best of dual feasible functions (Fekete and Schepers, 2001).

    Lengths under e count nothing and those over capacity - e a whole bin; then, for k, a length counts as many k-ths of a bin as it has whole (k + 1)-ths of the capacity, or its own share where that is a whole
    number of them.  k = 1 counts pieces over half a bin, k = 2 over a third, and so on; without either the bound is ceil(tokens / capacity)."""
    lengths = np.flatnonzero(left).astype(np.int64)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return 0
    n = left[lengths].astype(np.int64)
    edges = np.concatenate([[0], lengths[lengths <= capacity // 2] + 0])
    best = 0
    for e in np.unique(edges):
        x = np.where(lengths < e, 0, np.where(lengths > capacity - e, capacity, lengths)) if e else lengths
        best = max(best, int(-(-(x * n).sum() // capacity)))
        k = np.arange(1, 13)[:, None]
        parts = (k + 1) * x
        share = np.where(parts % capacity == 0, k * x, parts // capacity * capacity)  # in capacity * k-ths
        best = max(best, int((-(-(share * n).sum(axis=1) // (capacity * k[:, 0]))).max()))
    return best


def solve(left: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """(filling, times) that together use every piece; left[n] is the number of pieces of length n."""
    bins = lambda s: sum(n for _, n in s)
    total = int((np.arange(len(left)) * left).sum())
    bound = least_bins(left, capacity)
    best = best_fit(left, capacity)
    budget = [nodes]

    def complete(c: Counts) -> list[tuple[tuple[int, ...], int]]:
        """Fills down the first branches only, to have a solution of good fillings at once."""
        out = []
        while largest := c.below(capacity):
            _, filling = fillings(c, largest, capacity)[0]
            n = max(1, c.times(filling))
            c.take(filling, n)
            out.append((filling, n))
        return out

    first = complete(Counts(left)) if bins(best) > bound else best
    best = min(best, first, key=bins)
    # depth first with its own stack: each level holds its untried fillings and what it has taken
    c, taken, wasted = Counts(left), [], 0
    stack = [fillings(c, l, capacity)] if (l := c.below(capacity)) else []
    while stack and bins(best) > bound and budget[0] > 0:
        allowed = (bins(best) - 1) * capacity - total
        if stack[-1]:
            budget[0] -= 1
            waste, filling = stack[-1].pop(0)
            n = c.times(filling)
            if wasted + waste * n > allowed:
                n = 1
            if wasted + waste * n > allowed:
                continue
            c.take(filling, n)
            taken.append((filling, n, waste))
            wasted += waste * n
            largest = c.below(capacity)
            if not largest:
                best = [(f, k) for f, k, _ in taken]
            stack.append(fillings(c, largest, capacity) if largest else [])
        else:
            stack.pop()
            if taken:
                filling, n, waste = taken.pop()
                c.take(filling, -n)
                wasted -= waste * n
    return best


def slots(solution: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, sequence, offset): pieces lo to hi - 1 of a length go to sequence + number - lo, at the offset."""
    used: dict[int, int] = {}
    out, base = [], 0
    for filling, times in solution:
        offset = 0
        for length in filling:
            lo = used.get(length, 0)
            out.append((length, lo, lo + times, base, offset))
            used[length] = lo + times
            offset += length
        base += times
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with sequence_id and offset; parts are read several times."""
    spark = parts.sparkSession
    counted = parts.groupBy("length").count().collect()  # at most `capacity` rows
    left = np.zeros(capacity + 1, np.int64)
    for r in counted:
        left[r[0]] = r[1]
    table = slots(solve(left, capacity))
    plan = spark.createDataFrame(table or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, sequence long, offset long")
    salts = spark.createDataFrame([(int(n), int(-(-left[n] // BUCKET))) for n in np.flatnonzero(left)] or [(0, 1)], "length long, salts int")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("salts"))
    salted = parts.join(F.broadcast(salts), "length").withColumn("salt", salt)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = salted.withColumn("nth", nth).join(offsets, ["length", "salt"]).withColumn("number", F.col("before") + F.col("nth") - 1)
    # slots of a length in blocks by number, so that a lookup meets few of them
    by_length = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "sequence", "offset"))).alias("slots"))
    found = numbered.join(F.broadcast(by_length), "length").withColumn("slot", _slot_of(F.col("slots"), F.col("number")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot.sequence") + F.col("number") - F.col("slot.lo")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def _slot_of(found, number):
    """The slot with lo <= number < hi."""
    return F.get(F.filter(found, lambda s: (s["lo"] <= number) & (number < s["hi"])), F.lit(0))


def report(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Packs every document; the tokenizer file travels by broadcast, so only the driver needs its path."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = str(public_tokenizers.path("word_bpe_49k.json"))
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    return pack(cut(pieces(docs, model)))
