"""Words and word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Words that a worker remembers hashes of; beyond that it starts anew, so its memory is bounded.
REMEMBERED = 120_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, width: int) -> np.ndarray:
    """A hash for each run of width words; shorter texts are one shingle of all their words, empty ones none."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < width:
        out = np.full(1, len(w), np.uint64) * GOLDEN
        for j in range(len(w)):
            out = mix(out + w[j : j + 1])
        return out
    n = len(w) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = mix(out + w[j : j + n])
    return out


def bag(text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and how often each occurs."""
    return np.unique(shingles(text, width), return_counts=True)
