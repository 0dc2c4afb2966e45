"""A pair of Bloom filters: keys seen once, and keys seen at least twice.

Every task fills a pair of its own. The words that are not empty travel, are united word by word, and the filter of
keys seen twice comes back as one array of fixed size. A key that occurs twice is always found in it; a key that
occurs once is found there by chance only. The size is a parameter, so what is broadcast has a bound whatever the
input is: a filter that is too small for its input lets more keys through, and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from parley.llm.common import sliced

#: Words of 64 bits in a filter, as a power of two: 16 MB, for some 10 million keys at 12 bits each.
WORD_BITS = 21
#: Words that travel in one row, as a power of two.
PIECE_BITS = 14
#: Rows that a task hashes at once.
AT_ONCE = 1000
#: Bits that a key sets in its word.
KEY_BITS = 4

_PIECES = "piece int, at binary, once binary, twice binary"


def places(hashes: np.ndarray, word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each hash and the bits it sets there."""
    bits = np.zeros(len(hashes), np.uint64)
    for k in range(KEY_BITS):
        bits |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return (hashes >> np.uint64(64 - word_bits)).astype(np.int64), bits


class Pair:
    """The two filters of one task."""

    def __init__(self, word_bits: int) -> None:
        self.word_bits = word_bits
        self.once = np.zeros(1 << word_bits, np.uint64)
        self.twice = np.zeros(1 << word_bits, np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        """Each element is one occurrence."""
        keys, counts = np.unique(hashes, return_counts=True)
        at, bits = places(keys, self.word_bits)
        again = (counts > 1) | ((self.once[at] & bits) == bits)
        np.bitwise_or.at(self.twice, at[again], bits[again])
        np.bitwise_or.at(self.once, at, bits)


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold."""
    at, bits = places(hashes, int(len(words)).bit_length() - 1)
    return (words[at] & bits) == bits


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece: one row per piece, with what at least two tasks or one task alone saw twice."""
    size = 1 << PIECE_BITS
    now, once, twice = None, np.zeros(size, np.uint64), np.zeros(size, np.uint64)

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(twice).astype(np.uint16)
        return pa.record_batch({"piece": pa.array([now], pa.int32()), "at": [at.tobytes()], "words": [twice[at].tobytes()]})

    for batch in batches:
        for piece, at, one, two in zip(*(batch.column(n).to_pylist() for n in ("piece", "at", "once", "twice"))):
            if piece != now:
                if now is not None:
                    yield done()
                now = piece
                once[:], twice[:] = 0, 0
            at = np.frombuffer(at, np.uint16)
            one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            twice[at] |= two | (once[at] & one)
            once[at] |= one
    if now is not None:
        yield done()


def seen_twice(
    df: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], word_bits: int = WORD_BITS
) -> Broadcast:
    """The broadcast filter of keys that occur at least twice in ``df``.

    ``hashes_of`` gives the 64-bit hashes of the keys of a batch, one element for each occurrence that counts.
    """
    piece_bits = min(PIECE_BITS, word_bits)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(word_bits)
        for batch in sliced(batches, AT_ONCE):
            pair.add(hashes_of(batch))
        used = np.flatnonzero(pair.once)
        for piece in np.unique(used >> piece_bits):
            at = used[np.searchsorted(used, piece << piece_bits) : np.searchsorted(used, (piece + 1) << piece_bits)]
            yield pa.record_batch(
                {
                    "piece": pa.array([piece], pa.int32()),
                    "at": [(at & ((1 << piece_bits) - 1)).astype(np.uint16).tobytes()],
                    "once": [pair.once[at].tobytes()],
                    "twice": [pair.twice[at].tobytes()],
                }
            )

    pieces = df.mapInArrow(filled, _PIECES).repartition("piece").sortWithinPartitions("piece")
    words = np.zeros(1 << word_bits, np.uint64)
    # at most 2^word_bits words come to the driver
    for piece, at, found in pieces.mapInArrow(_united, "piece int, at binary, words binary").toLocalIterator():
        words[(piece << piece_bits) + np.frombuffer(at, np.uint16).astype(np.int64)] = np.frombuffer(found, np.uint64)
    return df.sparkSession.sparkContext.broadcast(words)


def seen(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], word_bits: int = WORD_BITS) -> Broadcast:
    """The broadcast filter of keys that occur in ``df`` at all: every occurrence is put in twice."""
    return seen_twice(df, lambda batch: np.repeat(hashes_of(batch), 2), word_bits)
