"""Words of a text as 64-bit hashes, and hashes of their n-grams."""

from __future__ import annotations

import numpy as np
import xxhash

from parley.llm.common import LOWER, mixed

#: Words whose hash a task remembers.
CACHED_WORDS = 300_000


class WordHashes(dict):
    """Hash of a word, remembered; words are runs without ASCII white space."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or b"").translate(LOWER).split()


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` elements; none if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, np.uint64(n))
    for k in range(n):
        total = mixed(total) + hashes[k : k + count]
    return mixed(total)


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` (minimum or maximum) over every run of ``width`` elements."""
    count, span, now = len(values) - width + 1, 1, values
    if count <= 0:
        return values[:0]
    while span * 2 <= width:
        now = op(now[:-span], now[span:])
        span *= 2
    rest = width - span
    return op(now[:count], now[rest : rest + count])
