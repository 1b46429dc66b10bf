"""Word shingles as 63-bit hashes, for the operators that compare texts by them."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the words of a shingle, from a fixed generator seed.
_FACTORS = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
TOP = np.uint64((1 << 63) - 1)


class WordHashes(dict):
    """Word (UTF-8 bytes) to a 64-bit hash; starts anew when full, values stay the same."""

    most = 1_000_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, split at space and \\t \\n \\v \\f \\r only."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """63-bit hash of every window of ``size`` words; a shorter text is one window, no words none."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    width = min(n, size)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * _FACTORS[k]
    return (mix(total + np.uint64(width)) & TOP).astype(np.int64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingles of a text."""
    return np.unique(window_hashes(word_hashes(text), size))
