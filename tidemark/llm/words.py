"""Words and word n-grams as 64-bit numbers, for use inside Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a run of letters and digits.
WORD = re.compile(r"[^\W_]+")

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_32 = np.uint64(32)


class WordNumbers(dict):
    """Hash of each word, remembered; it starts anew when it holds ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Numbers of the lower-cased words of ``text``; none for null."""
        if not text:
            return np.empty(0, np.uint64)
        found = WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _32)) * _MIX
    return x ^ (x >> _32)


def grams(numbers: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, in order."""
    m = len(numbers) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = mixed(total * _STEP + numbers[k : k + m])
    return total
