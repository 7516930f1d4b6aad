"""Token ids of whole texts from remembered ids of their parts.

The tokenizer splits at white space and between letters, digits and signs before it merges anything, so a text's ids are
those of its parts in a row.  A slice of texts is cut into parts with numpy; each distinct part goes through the tokenizer once and is
remembered by a 64-bit hash; its bytes are kept too and compared, so a part whose hash is another's never gets that one's ids.  New parts of ASCII letters, of signs
or of one digit are words to the tokenizer's merging model and go to it directly.  A cut is made only where the tokenizer surely makes one: at white space, and between two
ASCII characters of which neither composes with, nor is a contraction or a special token with, the other.  Parts with
bytes beyond ASCII, or with a bar (special tokens have bars), keep their case, since normal forms and special tokens depend on it; of
all others the lower case is taken, as the tokenizer does.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .textkit import Hasher, eights, lower_ascii, same_bytes, utf8

#: Parts that are remembered at most; then the memory starts anew.  The table has 2**SLOT_BITS places.
MOST_PARTS, SLOT_BITS = 600_000, 20

# Classes of bytes.  OTHER is never cut from its neighbours (control characters, the bar, bytes beyond ASCII).
SPACE, LETTER, DIGIT, SIGN, APOSTROPHE, OTHER = range(6)


def _classes() -> np.ndarray:
    c = np.full(256, OTHER, np.uint8)
    c[0x21:0x7F] = SIGN
    c[[0x20, *range(0x09, 0x0E)]] = SPACE
    c[0x41:0x5B] = c[0x61:0x7B] = LETTER
    c[0x30:0x3A] = DIGIT
    c[0x27], c[0x7C] = APOSTROPHE, OTHER
    return c


def _cuts() -> np.ndarray:
    cut = np.zeros((6, 6), bool)
    cut[SPACE, :] = cut[:, SPACE] = True
    for a, b in [(LETTER, DIGIT), (DIGIT, LETTER), (DIGIT, DIGIT), (LETTER, SIGN), (DIGIT, SIGN), (SIGN, LETTER), (SIGN, DIGIT), (LETTER, APOSTROPHE), (DIGIT, APOSTROPHE)]:
        cut[a, b] = True
    return cut


_CLASS, _CUT = _classes(), _cuts().ravel()


def parts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of each part, and of each text the first part's number."""
    kind = _CLASS[raw]
    cut = np.ones(len(raw) + 1, bool)
    cut[1:-1] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
    cut[at] = True
    edges = np.flatnonzero(cut)
    begin, end = edges[:-1], edges[1:]
    keep = kind[begin] != SPACE if len(raw) else np.zeros(0, bool)
    begin, end = begin[keep], end[keep]
    return begin, end, np.searchsorted(begin, at)


class WordIds:
    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.hasher = Tokenizer.from_str(tokenizer_json), Hasher()
        self._forget()

    def _forget(self) -> None:
        self.keys, self.values = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.text, self.text_begin, self.text_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's part; -1 if it isn't known."""
        out, live, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), self._slot(h)
        while len(live):
            key = self.keys[slot]
            hit = key == h[live]
            out[live[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            live, slot = live[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _keep(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = self._slot(h)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            taken, one = np.unique(slot[free], return_index=True)
            self.keys[taken], self.values[taken] = h[free[one]], number[free[one]]
            on = np.ones(len(h), bool)
            on[free[one]] = False
            h, number, slot = h[on], number[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)

    def _learn(self, h: np.ndarray, texts: list[bytes], plain: np.ndarray) -> None:
        """Remembers the parts; plain: which of them are one word to the merging model."""
        merged, rest = self.tokenizer.model.tokenize, np.flatnonzero(~plain)
        as_text = [t.decode("utf-8", "replace") for t in texts]
        found = [[t.id for t in merged(as_text[i])] for i in np.flatnonzero(plain)]
        found += [e.ids for e in self.tokenizer.encode_batch_fast([as_text[i] for i in rest], add_special_tokens=False)]
        h, size = np.concatenate([h[plain], h[rest]]), np.array([len(f) for f in found], np.int64)
        self._keep(h, len(self.size) + np.arange(len(h)))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.uint32)])
        order = [*np.flatnonzero(plain), *rest]
        raw = [texts[i] for i in order]
        length = np.array([len(t) for t in raw], np.int64)
        self.text_begin = np.concatenate([self.text_begin, len(self.text) + np.cumsum(length) - length])
        self.text_size = np.concatenate([self.text_size, length])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(raw), np.uint8)])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id after each, and where each text's ids begin (and, last, the number of ids)."""
        raw, at = utf8(texts)
        low = lower_ascii(raw)
        begin, end, first = parts(raw, at)
        odd = np.concatenate([[0], np.cumsum((raw >= 0x80) | (raw == 0x7C))])
        odd = odd[end] > odd[begin]
        which = np.flatnonzero(odd)
        cased = np.zeros(len(raw) + 1, np.int8)
        cased[begin[which]] += 1  # parts don't overlap, so an end may be another's begin
        np.subtract.at(cased, end[which], 1)
        own = np.where(np.cumsum(cased[:-1]).astype(bool), raw, low)
        h = self.hasher.spans(own, begin, end)
        h[which] = self.hasher.spans(own, begin[which], end[which], seed=1)
        h[h == 0] = 1  # 0 marks free places
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            keys, one = np.unique(h[new], return_index=True)
            if len(self.size) + len(keys) > MOST_PARTS:
                self._forget()
                new = np.arange(len(h))
                keys, one = np.unique(h, return_index=True)
            if len(keys) > MOST_PARTS:  # a slice of one immense text
                return self._whole(texts, end_id)
            one = new[one]
            kind = np.concatenate([[0], np.cumsum((_CLASS[raw] >= APOSTROPHE))])
            self._learn(keys, [own[begin[i] : end[i]].tobytes() for i in one], kind[end[one]] == kind[begin[one]])
            number[new] = self._find(h[new])
        part_begin, part_size, part_ids = self.begin, self.size, self.ids
        same = same_bytes(eights(own), begin, end - begin, eights(self.text), self.text_begin[number], self.text_size[number])
        if not same.all():  # hashes of others: these parts go through the tokenizer on their own
            other = np.flatnonzero(~same)
            found = [e.ids for e in self.tokenizer.encode_batch_fast([own[begin[i] : end[i]].tobytes().decode("utf-8", "replace") for i in other], add_special_tokens=False)]
            length = np.array([len(f) for f in found], np.int64)
            number[other] = len(part_size) + np.arange(len(other))
            part_begin, part_size = np.concatenate([part_begin, len(part_ids) + np.cumsum(length) - length]), np.concatenate([part_size, length])
            part_ids = np.concatenate([part_ids, np.array([i for f in found for i in f], np.uint32)])
        size = part_size[number]  # of each part
        text = np.repeat(np.arange(len(at) - 1), np.diff(first))
        place = np.cumsum(size) - size
        ids = np.full(int(size.sum()) + len(at) - 1, end_id, np.uint32)
        nth = np.arange(int(size.sum())) - np.repeat(place, size)
        ids[np.repeat(place + text, size) + nth] = part_ids[np.repeat(part_begin[number], size) + nth]
        per_text = np.bincount(text, size, len(at) - 1).astype(np.int64) + 1
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    def _whole(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        found = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([i for f in found for i in f], np.uint32), np.cumsum([0, *map(len, found)])
