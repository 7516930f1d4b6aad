"""Scalar column functions: sequences, contigs, labels and positions; all of them JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_trailing(s: Column, char: str) -> Column:
    """Length of the run of char that ends s."""
    return F.length(s) - F.length(F.regexp_replace(s, f"(?:{char})+$", ""))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(F.upper(s), "ACGTN", "TGCAN"))


def edit_distance_hw(query: Column, target: Column) -> Column:
    """Least edit distance of query to target or to any window of target of query's length."""
    n, m = F.length(query), F.length(target)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(m - n + 1, F.lit(1))), lambda i: F.levenshtein(query, F.substring(target, i, n)))
    return F.when((n == 0) | (m == 0), n).otherwise(F.least(F.when(m >= n, F.array_min(windows)), F.levenshtein(query, target)))


def orientation(s: Column, front: str, rear: str, window: int = 150, least: float = 0.6, apart: int = 10) -> Column:
    """A, T or unknown by the better primer layout; front and rear are the primers as they lie in a poly(A) read (rear trimmed of trailing T)."""
    rear = rear.rstrip("T")
    complement = str.maketrans("ACGTN", "TGCAN")
    rc = lambda x: F.lit(x.translate(complement)[::-1])
    up = F.upper(s)
    top, bottom = F.substring(up, F.lit(1), F.lit(window)), F.right(up, F.lit(window))
    v1 = edit_distance_hw(F.lit(front), top) + edit_distance_hw(rc(rear), bottom)
    v2 = edit_distance_hw(F.lit(rear), top) + edit_distance_hw(rc(front), bottom)
    score = 1 - F.least(v1, v2) / F.lit(float(len(front) + len(rear)))
    sure = (score >= least) & (F.abs(v1 - v2) > apart)
    return F.when(s.isNull() | (F.length(s) < 50) | ~sure, "unknown").when(v1 < v2, "A").otherwise("T")


def position_estimate(length: Column, tail_start: Column, tail_end: Column, chunk_start: Column, digits: int = 0) -> Column:
    """Distance of a chunk's centre (start + 49.5 of 100) from the tail's end, in nucleotides, half to even."""
    samples = 0.2 * (tail_end - tail_start)
    return F.bround(length - F.try_divide(length * (chunk_start + 49.5), samples), digits)


def signal_position(pos: Column, length: Column, tail_start: Column, tail_end: Column) -> Column:
    """The raw sample of a position: the inverse of position_estimate on the unscaled signal."""
    return F.bround(tail_start + F.try_divide((length - pos) * (tail_end - tail_start), length), 0)


def layout(tail_start: Column, tail_end: Column, samples: Column, least: int = 100, ratio: float = 1.5) -> Column:
    before, after = tail_start - 1, samples - tail_end
    unclear = before.isNull() | after.isNull() | (F.least(before, after) < least) | (F.greatest(before, after) / F.least(before, after) < ratio)
    return F.when(before.isNull() | after.isNull() | (F.least(before, after) < least), "ambiguous").when(unclear, "ambiguous").when(before > after, "polyA_layout").otherwise("polyT_layout")


def agreement(tail_type: Column, inferred: Column) -> Column:
    called = tail_type.isin("polyA", "polyT")
    return F.when(~F.coalesce(called, F.lit(False)), "-").when(inferred == "ambiguous", "?").when(F.concat(tail_type, F.lit("_layout")) == inferred, "=").otherwise("x")


def corrected_label(c: Column) -> Column:
    return F.when(c == "modified", "decorated").when(c == "unmodified", "blank").otherwise(c)


def at_end(pos: Column, length: Column) -> Column:
    """Whether a residue lies within two nucleotides of either end of the tail."""
    return (pos < 2) | (pos > length - 2)


def comment_code(direction: Column, mapq: Column, length: Column, start: Column, blank: Column) -> Column:
    """The reason code of a read without residues."""
    return F.when((direction == "*") & (mapq == 0), "UNM").when(length < 10, "IRL").when(start == 0, "BAC").when(blank, "MPU").otherwise("MAU")


def guppy_code(length: Column, qc: Column, blank: Column, pass_only: bool = True) -> Column:
    code = F.when(length < 10, "IRL")
    if pass_only:
        code = code.when(qc == "SUFFCLIP", "NIN")
    return code.when(qc.isin("ADAPTER", "NOREGION", "READ_FAILED_LOAD"), "QCF").when(blank, "MPU").otherwise("MAU")


def class_of(code: Column) -> Column:
    return F.when(code == "YAY", "decorated").when(code.isin("MPU", "MAU"), "blank").otherwise("unclassified")


def position_bin(pos: Column, width: int = 5) -> Column:
    """The upper edge of a right-closed bin; null for positions not over zero."""
    return F.when(pos > 0, width * F.ceil(pos / width))


def integer_mode(c: Column) -> Column:
    """The most frequent whole part over zero, of equals the least; 1 if there is none."""
    whole = c.cast("int")
    return F.coalesce(F.mode(F.when(whole > 0, whole), True), F.lit(1))


def corrected_warning(c: Column, test: Column) -> Column:
    """A label with -WARN where a test holds."""
    return F.when(F.coalesce(test, F.lit(False)), F.concat(c, F.lit("-WARN"))).otherwise(c)


def guppy_position(length: Column, samples: Column, chunk_start: Column) -> Column:
    """A chunk's distance from the tail's end by the tail's own number of samples; centre start + 50, two decimals."""
    return F.bround(length - F.try_divide(length * (chunk_start + 50), samples), 2)


def tail_type(call: Column) -> Column:
    return F.when(call == "A", "polyA").when(call == "T", "polyT").otherwise("unidentified")


def cdna_code(decorated: Column, blank: Column, length: Column) -> Column:
    """The reason code of a cDNA read; a short tail goes before all else."""
    return F.when(length < 10, "IRL").when(blank, "MPU").when(decorated, "YAY").otherwise("MAU")


def safe_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", "_")


def best_match(sequence: Column, primer: str, begin: int, end: int) -> Column:
    """struct(position, distance, matched) of the first best window of a primer's length in a stretch (places from 1)."""
    n = len(primer)
    starts = F.sequence(F.lit(begin), F.greatest(F.least(F.lit(end), F.length(sequence)) - n + 1, F.lit(begin)))
    each = F.transform(starts, lambda i: F.struct(F.levenshtein(F.lit(primer), F.substring(sequence, i, F.lit(n))).alias("distance"), i.alias("position")))
    best = F.array_min(each)
    return F.struct(best["position"].alias("position"), best["distance"].alias("distance"), F.substring(sequence, best["position"], F.lit(n)).alias("matched"))


def oriented_primers(sequence: Column, call: Column, front: str, rear: str, window: int = 150) -> Column:
    """The best matches of both primers for the chosen layout; anything but T is read as A."""
    swap = str.maketrans("ACGTN", "TGCAN")
    rc = lambda x: x.translate(swap)[::-1]
    bottom = F.right(sequence, F.lit(window))
    a = F.struct(best_match(sequence, front, 1, window).alias("top"), best_match(bottom, rc(rear), 1, window).alias("bottom"))
    t = F.struct(best_match(sequence, rear, 1, window).alias("top"), best_match(bottom, rc(front), 1, window).alias("bottom"))
    return F.when(call == "T", t).otherwise(a)
