"""Word shingles of a UTF-8 text as sorted, distinct 64-bit hashes (numpy, inside a task)."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash. The first ``limit`` words are remembered; any other word is hashed each time."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit and len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def sequence_shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` words, in text order; fewer words give one hash of all, no word gives none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    with np.errstate(over="ignore"):
        out = hashes[: n - width + 1] + np.uint64(width)
        for j in range(1, width):
            out = out * _STEP + hashes[j : n - width + 1 + j]
    return mix(out)


def split_words(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased; every other byte stays as it is."""
    return text.lower().split() if text else []
