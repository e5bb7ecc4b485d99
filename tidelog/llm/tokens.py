"""Words and their hashes for many texts at once, on the bytes of their UTF-8 form, with numpy."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
STEP = np.uint64(0xD6E8FEB86659FD93)  # of hashes of several words
MIX = np.uint64(0xFF51AFD7ED558CCD)
STRETCH = 1 << 17  # bytes that are summed at once


def word_table() -> np.ndarray:
    """True for bytes of words: 0-9, a-z and all of characters outside ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts, laid end to end: starts and ends in data, hashes, and the text that each belongs to."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        self.data = b"\0".join(texts) + b"\0"
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(self.data, np.uint8)
        inside = table[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.text = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.hashes = _hashes(raw, self.starts, self.ends)
        self.counts = np.bincount(self.text, minlength=len(texts))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on; whether they lie in one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = self.hashes[:n].copy()
        for i in range(1, k):
            h *= STEP
            h += self.hashes[i : i + n]
        return mixed(h), self.text[:n] == self.text[k - 1 :]

    def words(self, at: int, n: int) -> bytes:
        """n words from the word at on, joined by spaces."""
        return b" ".join(self.data[s:e] for s, e in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n at least of BASE and INVERSE; they are kept for the next call."""
    if not _POWERS or len(_POWERS[0]) <= n:
        ones = np.ones(1, np.uint64)
        _POWERS[:] = [np.cumprod(np.concatenate([ones, np.full(max(n, STRETCH), x, np.uint64)]), dtype=np.uint64) for x in (BASE, INVERSE)]
    return _POWERS[0], _POWERS[1]


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial in each word's bytes, by differences of running sums over stretches of the data."""
    found = np.empty(len(starts), np.uint64)
    stretch, at = STRETCH, 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + stretch, "right")))
        n = int(ends[to - 1] - first)
        powers, inverses = _powers(n)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw[first : first + n].astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)])
        s, e = starts[at:to] - first, ends[at:to] - first
        found[at:to] = (sums[e] - sums[s]) * inverses[s]
        at = to
    return mixed(found)
