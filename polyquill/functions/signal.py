"""Array kernels on one signal, in numpy, and their Arrow-batched column forms."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quantile(ordered: np.ndarray, p: float) -> float:
    """Between the two nearest of ascending values, rounded once where their shares are added, as SQL's quantile_cont has it: a last bit decides whether a whole number is cut to the one below."""
    at = (len(ordered) - 1) * p
    low, high = math.floor(at), math.ceil(at)
    a, b, share = float(ordered[low]), float(ordered[high]), at - low
    return a if low == high else math.fma(a, 1.0 - share, b * share) if math.isfinite(a) and math.isfinite(b) else a * (1.0 - share) + b * share


def winsorize(x: np.ndarray, low: float = 0.005, high: float = 0.995) -> np.ndarray:
    """Values clipped to two quantiles, cut to whole numbers."""
    x = np.asarray(x, float)
    if not len(x):
        return x.astype(np.int64)
    ordered = np.sort(x)
    return np.trunc(np.clip(x, quantile(ordered, low), quantile(ordered, high))).astype(np.int64)


def resample(x: np.ndarray, share: float = 0.2) -> np.ndarray:
    """Linear interpolation at ceil(share * n) evenly spaced places, ends included, half to even."""
    n = len(x)
    return np.rint(np.interp(np.linspace(0, n - 1, int(np.ceil(share * n))), np.arange(n), x)).astype(np.int64) if n else np.zeros(0, np.int64)


def fill_gaps(moves: np.ndarray) -> np.ndarray:
    """A single zero between equal neighbours takes their value."""
    out = np.array(moves)
    if len(out) > 2:
        gap = (out[1:-1] == 0) & (out[:-2] == out[2:]) & (out[:-2] != 0)
        out[1:-1][gap] = out[:-2][gap]
    return out


def most_frequent(x: np.ndarray, n: int) -> np.ndarray:
    """At most n distinct values, the most frequent first, the lesser first of equally frequent ones."""
    values, count = np.unique(np.asarray(x, float), return_counts=True)
    return values[np.argsort(-count, kind="stable")][:n]


def pseudomoves(x: np.ndarray, lag: int = 100, threshold: float = 3.5, seed: int = 123) -> np.ndarray:
    """1, -1 or 0 for each sample: over, under or within the threshold of a moving baseline that outliers don't move; 0 for the first five.

    The baseline starts from draws of the 20 most frequent and the first 10 samples; where there are fewer, the places stay empty and don't count."""
    x = np.asarray(x, float)
    if not len(x):
        return np.zeros(0, np.int64)
    pool = np.full(30, np.nan)
    often = most_frequent(x, 20)
    pool[: len(often)], pool[20 : 20 + min(10, len(x))] = often, x[:10]
    y = np.concatenate([np.random.default_rng(seed).choice(pool, lag), x])
    kept, out = y.copy(), np.zeros(len(y), np.int64)

    def level(seen: np.ndarray) -> tuple[float, float]:
        seen = seen[~np.isnan(seen)]
        return (seen.mean() if len(seen) else np.nan), (seen.std(ddof=1) if len(seen) > 1 else np.nan)

    mean, sd = level(y[:lag])
    for i in range(lag, len(y)):
        if abs(y[i] - mean) > threshold * sd:
            out[i], kept[i] = np.sign(y[i] - mean), kept[i - 1]
        mean, sd = level(kept[i - lag : i + 1])
    out[lag : lag + 5] = 0
    return fill_gaps(out[lag:])


def pseudomoves_of(signals: list[np.ndarray], lag: int = 100, threshold: float = 3.5, seed: int = 123, draws: np.ndarray | None = None) -> list[np.ndarray]:
    """``pseudomoves`` of many signals of whole numbers at once: one step of time serves all rows, and a ring of the last samples keeps their number, sum and sum of squares.

    ``draws`` are ``lag`` places (0 to 29) of the pool that a baseline starts from; without them they are drawn by the seed."""
    order = sorted((i for i in range(len(signals)) if len(signals[i])), key=lambda i: -len(signals[i]))
    out = [np.zeros(len(x), np.int64) for x in signals]
    if not order:
        return out
    draws = np.random.default_rng(seed).choice(30, lag) if draws is None else np.asarray(draws)
    size = np.array([len(signals[i]) for i in order])
    n, rows = int(size[0]), len(order)
    pool = np.full((rows, 30), np.nan)
    x = np.zeros((n, rows))  # time first, so that a step is contiguous
    for k, i in enumerate(order):
        own = np.asarray(signals[i], float)
        often = most_frequent(own, 20)
        pool[k, : len(often)], pool[k, 20 : 20 + min(10, len(own))] = often, own[:10]
        x[: len(own), k] = own
    shift = x[0].copy()  # sums of squares stay small
    x -= shift
    begin = pool[:, draws].T - shift
    there = ~np.isnan(begin)
    ring = np.where(there, begin, 0.0)  # of the last lag samples; one more once the first has come
    ring = np.concatenate([ring, np.zeros((1, rows))])
    there = np.concatenate([there, np.zeros((1, rows), bool)])
    count, total, squares = there.sum(axis=0).astype(float), ring.sum(axis=0), (ring**2).sum(axis=0)
    last, last_there = ring[lag - 1].copy(), there[lag - 1].copy()
    moves = np.zeros((n, rows), np.int8)
    at = lag  # the ring's place that is replaced next
    live = np.searchsorted(-size, -np.arange(n), "left")  # rows that still have samples
    with np.errstate(divide="ignore", invalid="ignore"):
        for t in range(n):
            m = int(live[t])
            y, c, s, q = x[t, :m], count[:m], total[:m], squares[:m]
            over = c * y - s
            # |y - mean| > threshold * sd, with both sides times the count
            far = (over * over * (c - 1) > threshold * threshold * c * (c * q - s * s)) & (c > 1)
            moves[t, :m] = np.where(far, np.sign(over), 0)
            value, is_there = np.where(far, last[:m], y), np.where(far, last_there[:m], True)
            old, old_there = ring[at, :m].copy(), there[at, :m].copy()
            ring[at, :m], there[at, :m] = np.where(is_there, value, 0.0), is_there
            count[:m] = c + is_there - old_there
            new = ring[at, :m]
            total[:m], squares[:m] = s + new - old, q + new * new - old * old
            last[:m], last_there[:m] = new, is_there
            at = (at + 1) % (lag + 1)
    moves[:5] = 0
    for k, i in enumerate(order):
        out[i] = fill_gaps(moves[: size[k], k].astype(np.int64))
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and value of each run."""
    x = np.asarray(x)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(x))), x[start]


def _centred(x: np.ndarray, moves: np.ndarray, size: int, least: int, often: int, seed: int) -> list[tuple[int, np.ndarray]]:
    start, length, value = runs(moves)
    r, out = np.random.default_rng(seed), []
    for s, n, v in zip(start, length, value):
        if v and n >= least:
            first = int(s) + 1 + n // 2 - size // 2
            at = np.arange(first, first + size)
            inside = (at >= 1) & (at <= len(x))
            fill = r.choice(most_frequent(x, often), size)
            out.append((int(first), np.where(inside, np.asarray(x, float)[np.clip(at - 1, 0, len(x) - 1)], fill)))
    return out


def chunks(x: np.ndarray, moves: np.ndarray, size: int = 100, least: int = 5, seed: int = 123) -> list[tuple[int, np.ndarray]]:
    """(start from 1, samples) of a chunk centred on each run of at least ``least`` equal moves; what lies outside is drawn from the five most frequent values."""
    moves = np.array(moves)
    moves[-3:] = 0
    return _centred(x, moves, size, least, 5, seed)


def overlapping(x: np.ndarray, segment: int, overlap: int, seed: int = 123) -> list[np.ndarray]:
    """Segments that overlap; what the last ones lack is drawn from the ten most frequent values."""
    step, x, r = segment - overlap, np.asarray(x, float), np.random.default_rng(seed)
    often, parts = most_frequent(x, 10), [x[i : i + segment] for i in range(0, len(x), step)]
    return [np.concatenate([p, r.choice(often, segment - len(p))]) for p in parts]


def training_moves(x: np.ndarray, **how) -> np.ndarray:
    """Pseudomoves for training sets: gaps filled as ever, then the first five and the last six are zero."""
    out = pseudomoves(x, **how)
    out[:5] = 0
    out[len(out) - min(6, len(out)) :] = 0
    return out


def longest_run(x: np.ndarray, value: int | None = None) -> int:
    """Length of the longest run of a value, or of any but 0."""
    _, length, values = runs(x)
    fits = values != 0 if value is None else values == value
    return int(length[fits].max()) if fits.any() else 0


def guppy_chunks(x: np.ndarray, moves: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Chunks without the last three moves set to zero; those without any move are left out."""
    moves = np.asarray(moves)
    out = []
    for first, values in _centred(x, moves, 100, 5, 5, 123):
        inside = moves[max(first - 1, 0) : first + 99]
        if inside.any():
            out.append((first, values))
    return out


def signed_chunks(value: int):
    """Chunks for training whose own pseudomoves have a run of at least four of a value and that begin inside the signal."""

    def cut(x: np.ndarray, moves: np.ndarray) -> list[tuple[int, np.ndarray]]:
        found = _centred(x, np.asarray(moves), 100, 4, 3, 123)
        return [(first, values) for first, values in found if first >= 0 and longest_run(pseudomoves(values), value) >= 4]

    return cut


def pure_chunks(x: np.ndarray, moves: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Overlapping segments of a tail that nowhere has four moves in a row."""
    busy = np.convolve(np.asarray(moves) != 0, np.ones(4), "valid") if len(moves) >= 4 else np.zeros(0)
    if (busy >= 4).any():
        return []
    return [(1 + 50 * i, part) for i, part in enumerate(overlapping(x, 100, 50))]


def gaf(x: np.ndarray, method: str = "s") -> np.ndarray:
    """Gramian angular field, scaled to 0..1 with 4 decimals: of sums of arc cosines, or of sums of arc sines for "d"."""
    x = np.asarray(x, float)
    wide = x.max() - x.min()
    y = np.clip(2 * (x - x.min()) / wide - 1, -1, 1) if wide else np.zeros(len(x))
    g = np.cos(np.add.outer(a := np.arccos(y), a)) if method == "s" else np.sin(np.add.outer(a := np.arcsin(y), a))
    wide = g.max() - g.min()
    return np.round((g - g.min()) / wide if wide else np.zeros_like(g), 4)


def stacked_gaf(x: np.ndarray, size: int = 100) -> np.ndarray:
    """Both fields of a chunk of the length that the classifier takes."""
    if len(x) != size:
        raise ValueError(f"a chunk has {size} samples")
    return np.stack([gaf(x, "s"), gaf(x, "d")], axis=-1)


def gaf_of(chunks: np.ndarray) -> np.ndarray:
    """Both fields of each of many chunks of one length: (n, size, size, 2)."""
    x = np.asarray(chunks, float)
    low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    wide = np.where(high > low, high - low, 1.0)
    y = np.where(high > low, np.clip(2 * (x - low) / wide - 1, -1, 1), 0.0)
    fields = []
    for angle, of in ((np.arccos, np.cos), (np.arcsin, np.sin)):
        a = angle(y)
        g = of(a[:, :, None] + a[:, None, :])
        low, high = g.min(axis=(1, 2), keepdims=True), g.max(axis=(1, 2), keepdims=True)
        fields.append(np.round(np.where(high > low, (g - low) / np.where(high > low, high - low, 1.0), 0.0), 4))
    return np.stack(fields, axis=-1)


def density(x: np.ndarray, points: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A Gaussian kernel density over evenly spaced places (rule-of-thumb bandwidth)."""
    x = np.asarray(x, float)
    sd, iqr = x.std(ddof=1) if len(x) > 1 else 0.0, np.subtract(*np.quantile(x, [0.75, 0.25]))
    h = 0.9 * (min(sd, iqr / 1.34) or sd or abs(x[0]) or 1.0) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, points)
    values = sum(np.exp(-0.5 * ((grid - v) / h) ** 2) for v in x) / (len(x) * h * np.sqrt(2 * np.pi))
    return grid, values


def density_mode(x: np.ndarray, points: int = 512) -> float:
    """Where the density is highest."""
    grid, values = density(x, points)
    return float(grid[np.argmax(values)])


def _column(f, kind: T.DataType):
    return F.pandas_udf(lambda s: pd.Series([None if v is None else f(np.asarray(v)) for v in s]), kind)


clipped = _column(lambda x: winsorize(x, 0.002, 0.998), T.ArrayType(T.LongType()))
winsorized, resampled = (_column(f, T.ArrayType(T.LongType())) for f in (winsorize, resample))


def _moves(s: pd.Series) -> pd.Series:
    found = pseudomoves_of([np.zeros(0) if v is None else np.asarray(v, float) for v in s])
    return pd.Series([None if v is None else m for v, m in zip(s, found)])


moves = F.pandas_udf(_moves, T.ArrayType(T.LongType()))
#: So many entries of fields (2 MB) leave a batch at once; a larger field goes alone.
FIELD_ENTRIES = 1 << 18


def portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive items whose sizes are ``most`` together, or of one that is larger alone."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _fields(method: str) -> Callable:
    """A field is as large as its signal's square, so a batch of signals gives its fields in portions, whatever its number of rows."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for a, b in portions([0 if v is None else len(v) ** 2 for v in s], FIELD_ENTRIES):
                yield pd.Series([v if v is None or not len(v) else gaf(v, method).ravel() for v in s.iloc[a:b]], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))


gaf_rows, gaf_d_rows = _fields("s"), _fields("d")
training_moves_rows = _column(training_moves, T.ArrayType(T.LongType()))
run_rows = F.pandas_udf(lambda s: pd.Series([None if v is None else [{"start": int(a), "length": int(n), "value": int(x)} for a, n, x in zip(*runs(np.asarray(v)))] for v in s]), T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("value", T.IntegerType())])))
has_run = F.pandas_udf(lambda s: pd.Series([v is not None and longest_run(np.asarray(v)) >= 5 for v in s]), T.BooleanType())


def calibrated(signal, offset, scale):
    """Raw samples in picoampere, as a column of arrays."""
    return F.transform(signal, lambda x: (x + offset) * scale)


def segment(position, tail_start, tail_end):
    return F.when(position < tail_start, "adapter").when(position <= tail_end, "poly(A)").otherwise("transcript")


def tail_crop(signal, tail_start, tail_end, around: int = 150):
    """The tail with so many samples on both sides, as far as the signal goes; places from 1."""
    low, high = F.greatest(tail_start - around, F.lit(1)), F.least(tail_end + around, F.size(signal))
    return F.slice(signal, low.cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int"))


def overlay(position, label, half: int = 250, scale: float = 1.0):
    """The marked stretch around a residue's sample."""
    return F.struct(((position - half) * scale).alias("xmin"), ((position + half) * scale).alias("xmax"), label.alias("label"))
