"""Hashes of words and n-grams, as numpy arrays of unsigned 64-bit integers."""

from __future__ import annotations

import numpy as np
import xxhash

#: A worker forgets the hashes of words beyond this many; a cache without influence on results.
REMEMBERED = 150_000

U64 = np.uint64


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash for each word of a text; words are parted by U+0020 and U+0009 to U+000D only."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(_words.__getitem__, words), U64, len(words))
