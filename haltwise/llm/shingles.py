"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from haltwise.llm.common import give_back

#: Word hashes that a task remembers.
REMEMBERED_WORDS = 250_000
_MIX1, _MIX2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def forget() -> None:
    """At a task's end: a Python worker goes on to other tasks, of other operators too."""
    _words.clear()
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lowered; bytes.split() parts at exactly space, \\t, \\n, \\v, \\f and \\r."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of k words, in order; all words as one where there are fewer; nothing without words."""
    n = len(h)
    if n == 0:
        return h
    width = min(k, n)
    acc = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        acc = mix(acc * _BASE + h[i : n - width + 1 + i])
    return acc


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(window_hashes(word_hashes(words_of(text)), k))
