"""Elias-Fano sequences and an n-gram trie of order 3 whose levels lie in one memory-mapped buffer.

The trie is keyed by the nearer context word: level 1 holds the words v; level 2 the successors w of each v and the words u
before it; level 3, for every context (u, v), the successors w as their rank among the successors of v (context-relative
numbers, which are small).  Every level is one monotone sequence: the member of range r is stored as r * universe + value, so a search
inside a range is one successor search in the whole sequence.  Probabilities and back-off weights are codes of 12 bits, kept in 16.
"""

from __future__ import annotations

import mmap

import numpy as np

#: A code of 12 bits is that of -log10 p, up to 20, on a scale that is finest near 0.
_BEND, CODES = 1e4, 4096
_SCALE = (CODES - 1) / np.log1p(20 * _BEND)
_VALUE = 10.0 ** (-np.expm1(np.arange(CODES) / _SCALE) / _BEND)
#: Absolute discount.
DISCOUNT = 0.75
_CHUNK = 1 << 16


def quantised(p: np.ndarray) -> np.ndarray:
    return np.rint(np.log1p(np.clip(-np.log10(np.maximum(p, 1e-20)), 0, 20) * _BEND) * _SCALE).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return _VALUE[code]


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_COUNT = _BITS.sum(1, dtype=np.uint8)
#: _NTH[b, k]: place of the k-th one of byte b.
_NTH = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """A monotone sequence of integers: low bits packed, high bits in unary, with a count of ones before every 64 bits."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        head, self.low, self.high, self.ones = parts
        self.n, self.bits = int(head[0]), int(head[1])
        self.words = np.lib.stride_tricks.as_strided(self.low[:8].view("<u8"), (len(self.low) - 7,), (1,))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> list[np.ndarray]:
        v = values.astype(np.uint64)
        n = len(v)
        bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        for j in range(0, n, _CHUNK):  # chunks of whole bytes
            part = np.packbits(((v[j : j + _CHUNK, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
            low[j * bits // 8 : j * bits // 8 + len(part)] = part
        top = (v >> np.uint64(bits)).astype(np.int64)
        length = -(-(n + (int(top[-1]) if n else 0) + 2) // 64) * 64
        high = np.zeros(length, np.uint8)
        high[top + np.arange(n)] = 1
        ones = np.concatenate([[0], np.cumsum(high.reshape(-1, 64).sum(1, dtype=np.int64))])
        return [np.array([n, bits], np.int64), low, np.packbits(high, bitorder="little"), ones]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero of the high bits."""
        before = self.ones if one else self.zeros
        out = np.empty(len(k), np.int64)
        blocks = self.high.reshape(-1, 8)
        for j in range(0, len(k), _CHUNK):
            q = k[j : j + _CHUNK]
            at = np.searchsorted(before, q, "right") - 1
            at = np.clip(at, 0, len(blocks) - 1)
            bytes_ = blocks[at] if one else ~blocks[at]
            sums = np.cumsum(_COUNT[bytes_], 1, dtype=np.uint8)
            rest = (q - before[at]).astype(np.int64)
            byte = np.minimum((sums <= rest[:, None]).sum(1), 7)
            row = np.arange(len(q))
            rest -= np.where(byte > 0, sums[row, byte - 1], 0)
            out[j : j + _CHUNK] = at * 64 + byte * 8 + _NTH[bytes_[row, byte], np.clip(rest, 0, 7)]
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(np.int64) * self.bits
        return (self.words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i) << self.bits) | self._low(i).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first member not under x, and whether it equals x."""
        x = x.astype(np.int64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        top, want = x >> self.bits, (x & ((1 << self.bits) - 1)).astype(np.uint64)
        most = int(self.zeros[-1]) - 1  # the last zero's number
        beyond = top > most
        top = np.minimum(top, most)
        a = np.where(top > 0, self._select(np.maximum(top - 1, 0), False) - np.maximum(top - 1, 0), 0)
        b = self._select(top, False) - top
        a, b, last = np.where(beyond, self.n, a), np.where(beyond, self.n, b), np.where(beyond, self.n, b)
        while (live := np.flatnonzero(a < b)).size:
            mid = (a[live] + b[live]) >> 1
            under = self._low(mid) < want[live]
            a[live], b[live] = np.where(under, mid + 1, a[live]), np.where(under, b[live], mid)
        hit = np.zeros(len(x), bool)
        inside = np.flatnonzero(a < last)
        hit[inside] = self._low(a[inside]) == want[inside]
        return a, hit


class Trie:
    """A trie over a buffer made by ``Trie.build`` (bytes, an anonymous map, or a mapped file)."""

    def __init__(self, buffer) -> None:
        parts, at = [], 8
        for _ in range(int(np.frombuffer(buffer, np.int64, 1)[0])):
            kind, n = np.frombuffer(buffer, np.int64, 2, at)
            dtype = np.dtype(chr(int(kind) & 255) + str(int(kind) >> 8))
            parts.append(np.frombuffer(buffer, dtype, n, at + 16))
            at += 16 + -(-n * dtype.itemsize // 8) * 8
        self.sizes = parts[0]
        self.v, self.w, self.u, self.x, self.w_at = (EliasFano(parts[1 + 4 * i : 5 + 4 * i]) for i in range(5))
        self.p2, self.b2, self.p3, self.b3 = parts[21:25]

    @staticmethod
    def build(v: np.ndarray, w: np.ndarray, c: np.ndarray, base: np.ndarray, pair: np.ndarray, u: np.ndarray, c3: np.ndarray, apart: np.ndarray | None = None) -> mmap.mmap:
        """From seen pairs (v, w) in that order with counts and P(w), and seen triples (number of the pair, u, count); P(w | v) is taken as 0 in pairs that are apart."""
        words, first, of = np.unique(v, return_index=True, return_inverse=True)
        total, kinds = np.bincount(of, c, len(words)), np.bincount(of, minlength=len(words))
        back2 = DISCOUNT * kinds / np.maximum(total, 1)
        p2 = np.maximum(c - DISCOUNT, 0) / total[of] + back2[of] * base
        if apart is not None:
            p2[apart] = 0
        wide_w, wide_u = int(w.max(initial=0)) + 1, int(u.max(initial=0)) + 1
        rank = np.arange(len(v)) - first[of]
        wide_x = int(rank.max(initial=0)) + 1
        contexts, which = np.unique(of[pair].astype(np.int64) * wide_u + u, return_inverse=True)
        total3, kinds3 = np.bincount(which, c3, len(contexts)), np.bincount(which, minlength=len(contexts))
        back3 = DISCOUNT * kinds3 / np.maximum(total3, 1)
        p3 = np.maximum(c3 - DISCOUNT, 0) / total3[which] + back3[which] * p2[pair]
        key3 = which.astype(np.int64) * wide_x + rank[pair]
        order = np.argsort(key3)
        levels = [words, of.astype(np.int64) * wide_w + w, contexts, key3[order], first]
        parts = [np.array([wide_w, wide_u, wide_x], np.int64)] + [a for level in levels for a in EliasFano.encode(level)]
        parts += [quantised(p2), quantised(back2), quantised(p3[order]), quantised(back3)]
        size = 8 + sum(16 + -(-a.nbytes // 8) * 8 for a in parts)
        out = mmap.mmap(-1, size)
        out.write(np.int64(len(parts)).tobytes())
        for a in parts:
            out.write(np.array([ord(a.dtype.kind) | (a.dtype.itemsize << 8), len(a)], np.int64).tobytes() + a.tobytes() + bytes(-a.nbytes % 8))
        return out

    @classmethod
    def open(cls, path: str) -> Trie:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, base: np.ndarray) -> np.ndarray:
        """P(w | u v), given P(w) as base: the longest context that is known decides, by interpolation with the shorter ones."""
        wide_w, wide_u, wide_x = (int(s) for s in self.sizes)
        p = base.astype(float)
        r, ok = self.v.find(v)
        live = np.flatnonzero(ok)
        r, u, w = r[live], u[live].astype(np.int64), w[live].astype(np.int64)
        i, seen = self.w.find(r * wide_w + np.minimum(w, wide_w - 1))
        seen &= w < wide_w
        q = probability(self.b2[r]) * p[live]
        q[seen] = probability(self.p2[i[seen]])
        k, known = self.u.find(r * wide_u + np.minimum(u, wide_u - 1))
        known &= u < wide_u
        sub = np.flatnonzero(known)
        q[sub] *= probability(self.b3[k[sub]])
        sub = np.flatnonzero(known & seen)
        rank = i[sub] - self.w_at.get(r[sub])
        j, full = self.x.find(k[sub] * wide_x + rank)
        q[sub[full]] = probability(self.p3[j[full]])
        p[live] = q
        return p

    def back(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The share of P(w | v) in P(w | u v): 1 if the context (u, v) is unknown."""
        wide_u, out = int(self.sizes[1]), np.ones(len(u))
        r, ok = self.v.find(v)
        live = np.flatnonzero(ok)
        k, known = self.u.find(r[live] * wide_u + np.minimum(u[live], wide_u - 1))
        known &= u[live] < wide_u
        out[live[known]] = probability(self.b3[k[known]])
        return out
