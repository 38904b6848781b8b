"""Hashes of word n-grams and MinHash signatures, in numpy, for tasks."""

from __future__ import annotations

import math

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """64-bit hashes of all runs of ``words`` words: differences of prefix sums of a polynomial over the text's bytes.

    Words are runs without the blanks U+0020 and U+0009 to U+000D. A text with fewer words has one run, of all its words.
    """

    def __init__(self, words: int = 5, seed: int = 11):
        self.words = words
        self.codes = np.random.Generator(np.random.Philox(seed)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers, self.inverse = _powers(1 << 12, BASE), _powers(1 << 12, pow(BASE, -1, 1 << 64))

    def _reach(self, n: int) -> None:
        if n > len(self.powers):
            n = 1 << n.bit_length()
            self.powers, self.inverse = _powers(n, BASE), _powers(n, pow(BASE, -1, 1 << 64))

    def all(self, text: str | None) -> np.ndarray:
        """Hashes in text order, repeats included."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.uint64)
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        self._reach(len(data) + 1)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.codes[data] * self.powers[: len(data)], dtype=np.uint64)))
        first = np.concatenate(([0], ends[:-1]))
        if len(words) >= self.words:
            first, ends = first[: len(words) - self.words + 1], ends[self.words - 1 :]
        else:
            first, ends = first[:1], ends[-1:]
        x = (sums[ends] - sums[first]) * self.inverse[first]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def set(self, text: str | None) -> np.ndarray:
        return np.unique(self.all(text))


def bands_for(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so that a pair at the threshold meets in some band with this probability."""
    best = None
    for rows in range(1, hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{hashes} hashes can't reach a recall of {recall} at {threshold}")
    return best


class BandHasher:
    """64-bit hashes of the bands of a MinHash signature."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        draw = np.random.Generator(np.random.Philox(seed))
        self.bands, self.rows = bands, rows
        self.mul = draw.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = draw.integers(0, 1 << 32, bands * rows, np.uint32)
        self.mix = draw.integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of band hashes (signed) for each set; sets mustn't be empty."""
        x = np.concatenate(sets)
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        least = np.empty((len(self.mul), len(sets)), np.uint32)
        for k, (a, b) in enumerate(zip(self.mul, self.add)):
            y = x * a + b
            y ^= y >> np.uint32(15)
            least[k] = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), starts)
        parts = least.reshape(self.bands, self.rows, len(sets)).astype(np.uint64) + np.uint64(1)
        out = (parts * self.mix[:, :, None]).sum(axis=1, dtype=np.uint64)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += np.arange(self.bands, dtype=np.uint64)[:, None] * np.uint64(0x632BE59BD9B4E019)
        return (out ^ (out >> np.uint64(29))).T.astype(np.int64)
