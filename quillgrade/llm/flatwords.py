"""Token units of many texts at once, in flat arrays, with ids from a cache.

A text whose white space is single spaces and newlines, none at an end, is cut at
every space and newline, and inside these units wherever letters, digits and other
characters meet. Units that hold an apostrophe, a special-token opening or
characters beyond ASCII and the Latin-1 letters stay whole. Each unit is known by
a 64-bit keyed sum of its bytes; only units not met before are encoded, by the
callback. Other texts go to the callback whole.
"""

from __future__ import annotations

import numpy as np

from quillgrade.llm.common import gather, per_group

_RNG = np.random.default_rng(20240229)
_BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER, _DIGIT, _OTHER, _SPACE, _NEWLINE = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
for _b in range(256):
    if 65 <= _b <= 90 or 97 <= _b <= 122 or _b >= 128:
        _CLASS[_b] = _LETTER
    elif 48 <= _b <= 57:
        _CLASS[_b] = _DIGIT
_CLASS[32], _CLASS[10] = _SPACE, _NEWLINE


class _Powers:
    table = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if n > len(cls.table):
            table = np.full(max(n, 256), _BASE, dtype=np.uint64)
            table[0] = 1
            cls.table = np.cumprod(table, dtype=np.uint64)
        return cls.table


def plain(text: bytes) -> bool:
    """Whether single spaces and newlines are the only white space, none at an end."""
    s = text.decode()
    return bool(s) and " ".join(s.split()) == s.replace("\n", " ")


def cut(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the units of plain texts laid end to end, and whether each may need the full rules."""
    n = len(data)
    kind = _CLASS[data]
    start = np.ones(n, dtype=bool)
    start[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
    unit = kind >= _SPACE
    start[doc_starts] = unit[doc_starts] = True
    odd = ((data >= 0xC2) & (data != 0xC3)) | (data == 0x27)
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    odd[1:] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    of = np.cumsum(unit) - 1
    marked = np.bincount(of[odd], minlength=int(of[-1]) + 1) > 0 if n else np.zeros(0, bool)
    if marked.any():
        start = unit | (start & ~marked[of])
    at = np.flatnonzero(start)
    return at, marked[of[at]] if n else marked


def unit_keys(data: np.ndarray, at: np.ndarray, blank: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit key of each unit, from one start to the next; bytes marked ``blank`` at a unit's end don't count."""
    lens = np.diff(np.r_[at, len(data)])
    begin = int(at[0]) if len(at) else 0
    inside = np.arange(len(data) - begin) - np.repeat(at - begin, lens)
    terms = _BYTE_KEYS[data[begin:]] * _Powers.upto(int(lens.max()) + 1)[inside]
    if blank is not None:
        terms[blank[begin:]] = 0
        lens = np.add.reduceat((~blank[begin:]).astype(np.int64), at - begin)
    keys = np.add.reduceat(terms, at - begin)
    return keys ^ (keys >> np.uint64(29)) * _BASE + lens.astype(np.uint64)


class FlatEncoder:
    """``words(list of bytes, odd flags)`` encodes units, ``whole(list of bytes)`` texts; both give flat ids and counts."""

    def __init__(self, words, whole, most: int = 1_500_000):
        self.words, self.whole, self.most = words, whole, most
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _ids(self, keys: np.ndarray, first: np.ndarray, raw: bytes, at: np.ndarray, odd: np.ndarray):
        """Places and lengths of the distinct keys' ids."""
        if len(self.known) > self.most:
            self._forget()
        pos = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), dtype=bool)
        if len(self.known):
            new = self.known[np.minimum(pos, len(self.known) - 1)] != keys
        if new.any():
            ends = np.r_[at[1:], len(raw)]
            where = first[new]
            words = [raw[a:b] for a, b in zip(at[where].tolist(), ends[where].tolist())]
            made, lens = self.words(words, odd[where])
            if self.used + len(made) > len(self.ids):
                more = np.zeros(max(2 * len(self.ids), self.used + len(made)), np.int32)
                more[: self.used] = self.ids[: self.used]
                self.ids = more
            self.ids[self.used : self.used + len(made)] = made
            begin = self.used + np.cumsum(lens) - lens
            self.used += len(made)
            self.known = np.insert(self.known, pos[new], keys[new])
            self.at = np.insert(self.at, pos[new], begin)
            self.len = np.insert(self.len, pos[new], lens)
            pos = np.searchsorted(self.known, keys)
        return self.at[pos], self.len[pos].astype(np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and each text's number of ids."""
        simple = np.array([plain(t) for t in texts], dtype=bool)
        counts = np.zeros(len(texts), dtype=np.int64)
        flat = np.zeros(0, np.int32)
        if simple.any():
            own = [t for t, p in zip(texts, simple.tolist()) if p]
            raw = b"".join(own)
            sizes = np.array([len(t) for t in own], dtype=np.int64)
            begin = np.cumsum(sizes) - sizes
            data = np.frombuffer(raw, dtype=np.uint8)
            at, odd = cut(data, begin)
            keys, first, back = np.unique(unit_keys(data, at), return_index=True, return_inverse=True)
            places, lens = self._ids(keys, first, raw, at, odd)
            lens = lens[back]
            flat = self.ids[gather(places[back], lens)]
            units = np.diff(np.r_[np.searchsorted(at, begin), len(at)])
            counts[simple] = per_group(lens, units)
        if not simple.all():
            rest, n = self.whole([t for t, p in zip(texts, simple.tolist()) if not p])
            starts = np.cumsum(counts) - counts
            counts[~simple] = n
            starts[~simple] = len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, rest])[gather(starts, counts)]
        return flat, counts
