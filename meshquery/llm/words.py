"""Words and word shingles of whole Arrow text columns as 64-bit hashes, in NumPy.

A word is a maximal run of bytes other than blank and \\t \\n \\v \\f \\r; A-Z count as a-z. A word's hash is a
polynomial over its bytes modulo 2^64 with a fixed odd base, scrambled; polynomials of all words of a slice come from
one running sum, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

SHINGLE = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


class Words:
    """The words of a text column: ``start``/``end`` byte places in ``raw``, ``bounds`` of each text's words."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
        _, places, data = texts.buffers()
        self.offsets = np.frombuffer(places, dtype=np.int64, count=len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
        self.raw = np.frombuffer(data, dtype=np.uint8, count=int(self.offsets[-1])) if data and self.offsets[-1] else np.zeros(0, np.uint8)
        inside = ~_GAP[self.raw]
        before = np.zeros(len(inside) + 1, dtype=bool)
        before[1:] = inside
        before[self.offsets] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(inside) + 1, dtype=bool)
        after[:-1] = inside
        after[self.offsets] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        up, down = (t[: len(self.raw) + 1] for t in _tables(len(self.raw) + 1))
        total = np.zeros(len(self.raw) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[self.raw].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        return mixed((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def shingle_sets(self) -> list[np.ndarray]:
        """Per text the sorted distinct hashes of its five-word shingles; the whole sequence where it has fewer words."""
        words = self.hashes()
        n = len(words)
        grams = np.zeros(max(0, n - SHINGLE + 1), dtype=np.uint64)
        for k in range(SHINGLE):
            grams += words[k : n - SHINGLE + 1 + k] * _PLACE[k] if n >= SHINGLE else np.uint64(0)
        grams = mixed(grams)
        out = []
        for lo, hi in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            if hi - lo >= SHINGLE:
                out.append(np.unique(grams[lo : hi - SHINGLE + 1]))
            elif hi > lo:
                k = hi - lo
                out.append(mixed((words[lo:hi] * _PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k) * np.uint64(0x2545F4914F6CDD1D)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out
