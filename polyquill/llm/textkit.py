"""Vectorised text primitives shared by the corpus operators.

Texts arrive as Arrow string columns.  Their UTF-8 bytes are scanned with numpy, a few megabytes at a
time, so memory per task does not depend on how many rows a batch has.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is handled on its own.
SLICE_BYTES = 2_000_000

_SPACE = [0x20, *range(0x09, 0x0E)]


def space_words() -> np.ndarray:
    """Byte table of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[_SPACE] = False
    return table


def alnum_words() -> np.ndarray:
    """Byte table of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in lower-cased text."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text begins and ends in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(texts) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many bytes of text each, or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin, n = np.cumsum(size), 0, len(size)
    while begin < n:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; no other letter changes."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def word_spans(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of each word, and of each text the first word's number (and, last, the number of words)."""
    inside = table[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, at)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a range up to which it is hashed in blocks of eight; a longer one goes through BLAKE2b.
_BLOCKWISE = 256


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(raw) + 1,), (1,))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


#: Ranges hashed at once, so that the state stays in the cache.
_AT_ONCE = 8192
# The words that SipHash's state begins with.
_START = [0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _rounds(v: list[np.ndarray], n: int) -> None:
    for _ in range(n):
        v[0] += v[1]
        v[2] += v[3]
        v[1] = _turn(v[1], 13) ^ v[0]
        v[3] = _turn(v[3], 16) ^ v[2]
        v[0] = _turn(v[0], 32) + v[3]
        v[2] += v[1]
        v[3] = _turn(v[3], 21) ^ v[0]
        v[1] = _turn(v[1], 17) ^ v[2]
        v[2] = _turn(v[2], 32)


class Hasher:
    """64-bit hashes of byte ranges: SipHash-2-4 with a key from the seed, and BLAKE2b for ranges of over 256 bytes.

    Four words of state take up each block of eight bytes, so no block can undo another's difference, as it can where one word is chained.
    """

    def spans(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        size = end - begin
        blocks = eights(raw)
        key = mix(np.uint64([seed, seed + 1]) * _BASE + _BASE)
        h = np.empty(len(size), np.uint64)
        for i in np.flatnonzero(size > _BLOCKWISE):
            h[i] = np.frombuffer(hashlib.blake2b(raw[begin[i] : end[i]].tobytes(), digest_size=8, key=key.tobytes()).digest(), np.uint64)[0]
        whole = np.where(size <= _BLOCKWISE, size >> 3, -1)
        for n in np.flatnonzero(np.bincount(whole + 1)[1:]) if len(size) else []:
            of = np.flatnonzero(whole == n)
            for lo in range(0, len(of), _AT_ONCE):
                some = of[lo : lo + _AT_ONCE]
                h[some] = self._sip(blocks, begin[some], size[some], int(n), key)
        return h

    @staticmethod
    def _sip(blocks: np.ndarray, begin: np.ndarray, size: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
        v = [np.full(len(begin), np.uint64(c) ^ key[i % 2]) for i, c in enumerate(_START)]
        for j in range(n + 1):
            block = blocks[begin + 8 * j] if j < n else (blocks[begin + 8 * n] & _KEEP[size & 7]) | ((size & 255).astype(np.uint64) << np.uint64(56))
            v[3] ^= block
            _rounds(v, 2)
            v[0] ^= block
        v[2] ^= np.uint64(255)
        _rounds(v, 4)
        return v[0] ^ v[1] ^ v[2] ^ v[3]


def same_bytes(a: np.ndarray, a_begin: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_begin: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether range i of one text has the bytes of range i of another; a and b are the ``eights`` of the texts."""
    equal, at = a_size == b_size, 0
    live = np.flatnonzero(equal)
    while len(live := live[a_size[live] > at]):
        same = ((a[a_begin[live] + at] ^ b[b_begin[live] + at]) & _KEEP[np.minimum(a_size[live] - at, 8)]) == 0
        equal[live[~same]] = False
        live, at = live[same], at + 8
    return equal


def trim() -> None:
    """Gives freed memory back to the system, so that a worker's size follows what it holds and not what it once held."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its own policy
        pass
    pa.default_memory_pool().release_unused()


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def chained(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """One hash of several in a row, by steps that aren't linear."""
    k = odd_constants(len(parts) + 1, seed)
    out = np.full(len(parts[0]), k[-1])
    for h, c in zip(parts, k):
        out = mix((out ^ h) * c)
    return out


def windows(h: np.ndarray, first: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each n words in a row of one text, and of each text the first window's number."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    m = len(h) - n + 1
    out = chained([h[j : j + m] for j in range(n)], seed)
    whole = of[:m] == of[n - 1 :]
    count = np.maximum(np.diff(first) - n + 1, 0)
    return out[whole], np.concatenate([[0], np.cumsum(count)])
