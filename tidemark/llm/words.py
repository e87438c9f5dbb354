"""64-bit hashes of words and of runs of words, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

KNOWN_WORDS = 400_000
ODD = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """Hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; of all words where there are fewer, none if there are none."""
    n = min(n, len(hashes))
    if n == 0:
        return hashes
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * ODD + hashes[i:len(hashes) - n + 1 + i]
    return mix(out + np.uint64(n))
