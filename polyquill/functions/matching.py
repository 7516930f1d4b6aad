"""Edit distances of a short query to many texts at once, bit-parallel over Arrow batches, and the orientation of cDNA reads by their primers.

A column of the distance table is two 64-bit words of differences (Myers, 1999; Hyyro's form for whole strings), so one step takes up a character of every window of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two primers of the kit, and what an orientation is called by.
FRONT, REAR = "TTTCTGTTGGTGCTGATATTGCTTT", "ACTTGCCTGTCGCTCTATCTTCAGAGGAGAGTCCGCCGCCCGCAAGTTTT"
WINDOW, LEAST_SCORE, APART, SHORTEST = 150, 0.6, 10, 50
#: So many texts' windows are matched at once: their words stay in a core's cache.  So many tasks a core share the reads.
BLOCK, TASKS_A_CORE = 64, 4
_SWAP = str.maketrans("ACGTN", "TGCAN")


class Query:
    """A query of at most 64 bytes."""

    def __init__(self, query: str) -> None:
        raw = query.encode()
        if not 0 < len(raw) <= 64:
            raise ValueError("a query has 1 to 64 bytes")
        self.m = len(raw)
        self.equal = np.zeros(256, np.uint64)
        for i, c in enumerate(raw):
            self.equal[c] |= np.uint64(1 << i)

    def _steps(self, columns: Iterator[tuple[np.ndarray, np.ndarray | None]], n: int) -> np.ndarray:
        """Distances of n texts whose characters come column by column; a mask tells which texts still have one."""
        one, high = np.uint64(1), np.uint64(self.m - 1)
        up, down = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
        score = np.full(n, self.m, np.int64)
        for chars, more in columns:
            eq = self.equal[chars]
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up), up & xh
            change = ((ph >> high) & one).astype(np.int64) - ((mh >> high) & one).astype(np.int64)
            ph, mh = (ph << one) | one, mh << one
            new_up, new_down = mh | ~(xv | ph), ph & xv
            if more is None:
                score += change
                up, down = new_up, new_down
            else:
                score += np.where(more, change, 0)
                up, down = np.where(more, new_up, up), np.where(more, new_down, down)
        return score

    def whole(self, texts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Edit distance to each text; texts are rows of bytes, of which the first ``size`` count."""
        return self._steps(((texts[:, j], j < size) for j in range(int(size.max(initial=0)))), len(size))

    def within(self, texts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The least edit distance to a text or to any of its windows of the query's length; the query's length for an empty text."""
        best = self.whole(texts, size)
        order = np.argsort(size, kind="stable")  # texts of like size share a block, which is as wide as its largest
        order = order[size[order] >= self.m]
        for at in range(0, len(order), BLOCK):
            rows = order[at : at + BLOCK]
            best[rows] = np.minimum(best[rows], self._least_window(texts[rows, : int(size[rows[-1]])], size[rows]))
        return np.where(size == 0, self.m, best)

    def _least_window(self, texts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The least distance to a window of the query's length, which no text is shorter than: a step takes up a character of all windows, and the last column's differences add up to the distance."""
        starts, one = texts.shape[1] - self.m + 1, np.uint64(1)
        equal = self.equal[texts]
        up, down = np.full((len(texts), starts), ~np.uint64(0)), np.zeros((len(texts), starts), np.uint64)
        xv, xh, ph = (np.empty_like(up) for _ in range(3))
        for j in range(self.m):
            eq = equal[:, j : j + starts]
            np.bitwise_or(eq, down, out=xv)
            np.bitwise_and(eq, up, out=xh)
            xh += up
            xh ^= up
            xh |= eq
            np.bitwise_or(xh, up, out=ph)
            np.invert(ph, out=ph)
            ph |= down
            xh &= up
            ph <<= one
            ph |= one
            xh <<= one
            np.bitwise_or(xv, ph, out=up)
            np.invert(up, out=up)
            up |= xh
            np.bitwise_and(ph, xv, out=down)
        own = np.uint64((1 << self.m) - 1)
        found = self.m + np.bitwise_count(up & own).astype(np.int64) - np.bitwise_count(down & own)
        return np.where(np.arange(starts) <= (size - self.m)[:, None], found, self.m).min(axis=1)


def as_rows(texts: list[bytes], width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of one width, filled up with zeros, and their sizes."""
    size = np.array([len(t) for t in texts], np.int64)
    width = int(size.max(initial=0)) if width is None else width
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width), size


def reverse_complement(s: str) -> str:
    return s.translate(_SWAP)[::-1]


def orientations(sequences: list[str | None], front: str = FRONT, rear: str = REAR, window: int = WINDOW, least: float = LEAST_SCORE, apart: int = APART) -> list[str]:
    """A, T or unknown for each read, by which layout of both primers fits its ends better; null and short reads are unknown."""
    rear = rear.rstrip("T")
    out = ["unknown"] * len(sequences)
    long = [i for i, s in enumerate(sequences) if s is not None and len(s) >= SHORTEST]
    if not long:
        return out
    upper = [sequences[i].upper().encode("ascii", "replace") for i in long]
    top, bottom = as_rows([s[:window] for s in upper], window), as_rows([s[-window:] for s in upper], window)
    v1 = Query(front).within(*top) + Query(reverse_complement(rear)).within(*bottom)
    v2 = Query(rear).within(*top) + Query(reverse_complement(front)).within(*bottom)
    score = 1 - np.minimum(v1, v2) / (len(front) + len(rear))
    sure = (score >= least) & (np.abs(v1 - v2) > apart)
    for i, good, forward in zip(long, sure, v1 < v2):
        if good:
            out[i] = "A" if forward else "T"
    return out


def with_tail_type(reads: DataFrame, sequence: str = "sequence", out: str = "tail_type", most: int = 1000) -> DataFrame:
    """Reads with polyA, polyT or unidentified by the orientation of their sequence; so many reads are matched at once.

    Matching costs far more than moving a read, and a small file is one task's, so reads are first dealt out over all cores."""
    if sequence not in reads.columns:
        raise ValueError(f"missing columns: {sequence}")
    names = {"A": "polyA", "T": "polyT", "unknown": "unidentified"}
    columns = [c for c in reads.columns if c != out]
    call = orientations

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                b = whole.slice(at, most)
                called = [names[x] for x in call(b.column(sequence).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(called, pa.string())], [*columns, out])

    parts = TASKS_A_CORE * reads.sparkSession.sparkContext.defaultParallelism
    return reads.select(*columns).repartition(parts).mapInArrow(run, T.StructType([*(reads.schema[c] for c in columns), T.StructField(out, T.StringType())]))


def type_statistics(reads: DataFrame, column: str = "tail_type") -> DataFrame:
    """One row: reads, and how many of them, and what percentage with two decimals, are polyA, polyT and anything else."""
    kinds = ("polyA", "polyT")
    is_kind = {k.lower(): F.col(column) == k for k in kinds} | {"unidentified": ~F.coalesce(F.col(column).isin(*kinds), F.lit(False))}
    counts = reads.agg(F.count("*").alias("total_reads"), *(F.count_if(c).alias(f"{k}_reads") for k, c in is_kind.items()))
    return counts.select("*", *(F.coalesce(F.round(F.try_divide(F.col(f"{k}_reads"), F.col("total_reads")) * 100, 2), F.lit(0.0)).alias(f"{k}_percentage") for k in is_kind))


def write_classified(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Reads a table of sequences, writes it with its tail types beside it (``to``: what ``readers.classified_path`` gives) and returns what was written."""
    reads = spark.read.option("sep", "\t").option("header", True).csv(path)
    with_tail_type(reads).write.option("sep", "\t").option("header", True).csv(to)
    return spark.read.schema(T.StructType([*reads.schema.fields, T.StructField("tail_type", T.StringType())])).option("sep", "\t").option("header", True).csv(to)
