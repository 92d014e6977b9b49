"""Words and windows of words as 64-bit hashes."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

#: Distinct words that a task remembers at most.
REMEMBER = 100_000


class WordHashes(dict):
    """64-bit hash by word, as bytes; a full memory is emptied."""

    def __missing__(self, word: bytes) -> int:
        out = xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = out
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words; of the whole sequence as one where it has fewer, of none where it is empty."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(31) + h[i : len(h) - n + 1 + i])
    return out
