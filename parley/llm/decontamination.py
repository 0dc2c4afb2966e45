"""Benchmark decontamination by CGK random walks, bit sampling and exact edit distances.

A walk stands on a word and, at each step, stays or moves on by one, as a random bit of (walk, step, word) says. The words
under its steps are an embedding in which texts of small edit distance differ in few places. A signature is a hash of
sampled steps. Walks start at every word of a document and, for the item, at every word of it, so an equal signature says
where a window of the item's size would start; the exact edit distance of the item to the best window there decides.

How many walks, and how many steps of each, follow from an item's length and the edits it may have (``walks_for``): edits
cut an item into runs of unchanged words, and a walk that stays in a run gives equal signatures. The chance that it does,
while it also moves far enough to say something, is a sum of binomial terms; walks are added until ``RECALL`` is reached
for edits that are spread evenly, which is the worst case. Items that may have no edit (up to four words) are looked up
whole, as a walk that always moves, and are always found.

A document is contaminated by an item if a window of it is within ``1 - SIMILARITY`` of the item's words. Words are runs
without ASCII white space, A-Z in lower case, without punctuation at both ends; words of punctuation alone do not count.
Items are taken in blocks of bounded size, one pass over the documents for each. Items that are null or without words
match nothing, equal items match each. Null or empty texts have no words; texts of any length are taken whole. Rows of one
id are judged each; a null id is kept as null. Without documents, or without items, nothing matches.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parley.llm.common import lean, mixed, sliced, texts_of, typed
from parley.llm.words import WordHashes, lower_words

SIMILARITY = 0.8
#: The share of windows at the largest distance that walks find at least, as computed, and walks that should do.
RECALL = 0.999
WALKS = 6
#: Moves of a walk that say enough.
MOVES = 2
#: Items, and bytes of items, in one pass, about, and words of documents that are looked up at once.
ITEMS = 20_000
ITEM_BYTES = 16 << 20
AT_ONCE = 200_000
#: Documents that a task holds at once.
ROWS = 256
#: Bits of the table that holds back positions without a hit.
SIEVE = 20

_MARKS = string.punctuation.encode()
#: Stands behind the last word.
_PAD = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xBF58476D1CE4E5B9)


class CoreHashes(WordHashes):
    """Hash of a word without punctuation at both ends; 0 if nothing else is there."""

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_MARKS)
        found = xxhash.xxh3_64_intdigest(core) | 1 if core else 0
        if len(self) < 300_000:
            self[word] = found
        return found


def words_of(text: bytes | None, hashes: CoreHashes) -> np.ndarray:
    found = hashes.of(lower_words(text))
    return found[found != 0]


def walks_for(length: int, edits: int) -> tuple[int, int, int]:
    """Walks, steps of each and least moves for items of so many words that may have so many edits.

    Without edits: one walk that always moves.
    """
    if not edits:
        return 1, length - 1, length - 1
    clean, runs = max(0, length - edits), edits + 1
    sizes = [clean // runs + (i < clean % runs) for i in range(runs)]
    for least in range(max(0, min(MOVES, sizes[0] - 1)), -1, -1):
        steps = max(0, min(least + sizes[0] - 1, 2 * least + 1))
        # of each start in a run: the chance that its walk moves enough and does not leave the run
        missed = 0.0
        for size in sizes:
            for room in range(size):
                ways = sum(math.comb(steps, m) for m in range(least, min(room, steps) + 1))
                missed += math.log(max(1 - ways / 2**steps, 1e-12))
        walks = math.ceil(math.log(1 - RECALL) / missed) if missed else WALKS
        if walks <= WALKS:
            break
    return max(1, walks), steps, least


def walked(words: np.ndarray, walk: int | None, steps: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """After every step up to ``steps``: its number, the signatures and the moves of the walks from all words.

    A walk samples its first and last step and three of four others. ``None`` is the walk that always moves.
    """
    n, number = len(words), 0 if walk is None else walk + 1
    pad = np.full(steps + 1, _PAD)
    there = np.concatenate([words, pad])
    bits = mixed(there + np.uint64(number)) if number else None
    sampled = int(mixed(np.array([number], np.uint64))[0]) if number else -1
    start = np.arange(n)
    at, now = start, (words ^ np.uint64(number)) * _FACTOR
    yield 0, now, at - start
    for step in range(1, steps + 1):
        at = at + ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64) if number else at + 1
        with_this = (now ^ (now >> np.uint64(32)) ^ there[at]) * _FACTOR
        yield step, with_this, at - start
        if (sampled >> (2 * step)) & 3:
            now = with_this


def allowed(length: int, similarity: float) -> int:
    """Edits that an item of so many words may have."""
    return int(round((1 - similarity) * length * 1e6) // 1_000_000)


def edit_distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest distance of the item to any window of the text, and the end of the first such window (bit-parallel)."""
    m, masks = len(item), {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, word in enumerate(text):
        equal = masks.get(word, 0)
        xv = equal | down
        xh = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(xh | up), up & xh
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1, minus << 1
        up, down = (minus | ~(xv | plus)) & full, plus & xv & full
        if score < best[0]:
            best = (score, j + 1)
    return best


class Items:
    """The signatures of a block of items."""

    def __init__(self, items: list[tuple[object, bytes]], similarity: float) -> None:
        hashes = CoreHashes()
        self.names, self.words = [], []
        for name, text in items:
            own = words_of(text, hashes)
            if len(own):
                self.names.append(name)
                self.words.append(own)
        self.edits = [allowed(len(w), similarity) for w in self.words]
        self.lists = [w.tolist() for w in self.words]
        self.sorted = [np.unique(w) for w in self.words]
        found: dict[int | None, dict[int, list[tuple[np.ndarray, int, np.ndarray]]]] = {}
        for k, own in enumerate(self.words):
            walks, steps, least = walks_for(len(own), self.edits[k])
            for walk in range(walks) if self.edits[k] else [None]:
                *_, (_, signature, moves) = walked(own, walk, steps)
                # a walk that leaves the item says nothing about it
                stays = np.flatnonzero((moves >= least) & (np.arange(len(own)) + moves < len(own)))
                found.setdefault(walk, {}).setdefault(steps, []).append((signature[stays], k, stays))
        #: By walk and steps: signatures in order, their items and starts, and what holds back positions without a hit.
        self.tables: dict[int | None, dict[int, tuple[np.ndarray, ...]]] = {}
        for walk, by_steps in found.items():
            for steps, lists in by_steps.items():
                flat = np.concatenate([x[0] for x in lists])
                item = np.concatenate([np.full(len(x[0]), x[1]) for x in lists])
                begin = np.concatenate([x[2] for x in lists])
                order = np.argsort(flat, kind="stable")
                sieve = np.zeros(1 << SIEVE, bool)
                sieve[(flat >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
                self.tables.setdefault(walk, {})[steps] = flat[order], item[order], begin[order], sieve

    def _hits(self, words: np.ndarray) -> np.ndarray:
        """Rows of (item, position where it would start, position of the walk's start)."""
        found = [np.empty((0, 3), np.int64)]
        for walk, by_steps in self.tables.items():
            for steps, own, _ in walked(words, walk, max(by_steps)):
                if steps not in by_steps:
                    continue
                keys, item, begin, sieve = by_steps[steps]
                at = np.flatnonzero(sieve[(own >> np.uint64(64 - SIEVE)).astype(np.int64)])
                low, high = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
                count = high - low
                at, low, count = at[count > 0], low[count > 0], count[count > 0]
                which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                place = np.repeat(at, count)
                found.append(np.stack([item[which], place - begin[which], place], axis=1))
        return np.concatenate(found)

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Rows of (item, position where it would start), each once, in order."""
        return np.unique(self._hits(words)[:, :2], axis=0)

    def matches(self, words: np.ndarray, hits: np.ndarray) -> dict[int, tuple[int, int]]:
        """(distance, end) of the best window by item, of those that are near enough; ``hits`` are in order."""
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}
        for k, start in hits.tolist():
            edits, size = self.edits[k], len(self.lists[k])
            if start <= done.get(k, -1 << 60) or (k in best and best[k][0] == 0):
                continue
            begin = max(0, start - edits)
            end = start + size + 2 * edits + 1  # also serves the starts that follow closely
            region = words[begin:end]
            if np.isin(region, self.sorted[k]).sum() < size - edits:
                continue
            done[k] = start + edits
            distance, at = edit_distance(self.lists[k], region.tolist())
            if distance <= edits and (k not in best or (distance, begin + at) < best[k]):
                best[k] = (distance, begin + at)
        return best

    def found(self, texts: list[bytes | None], hashes: CoreHashes) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, end) of all matches; many texts are looked up at once."""
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            own = words_of(text, hashes)
            held.append((i, own))
            size += len(own) + 1
            if size < AT_ONCE and i + 1 < len(texts):
                continue
            flat = np.concatenate([x for _, words in held for x in (words, np.array([_PAD]))])
            ends = np.cumsum([len(words) + 1 for _, words in held])
            hits = self._hits(flat)
            owner = np.searchsorted(ends, hits[:, 2], "right")  # an item may start before the text that holds the walk
            order = np.lexsort((hits[:, 1], hits[:, 0], owner))
            hits, owner = hits[order, :2], owner[order]
            for n, (row, words) in enumerate(held):
                a, b = np.searchsorted(owner, [n, n + 1])
                if a == b:
                    continue
                mine = hits[a:b] - np.array([0, ends[n] - len(words) - 1])
                for k, (edits, behind) in sorted(self.matches(words, mine).items()):
                    yield row, k, edits, behind
            held, size = [], 0


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of about ``size`` items and ``ITEM_BYTES``, one after the other on the driver."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    count, n_bytes = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-count // size), -(-(n_bytes or 0) // ITEM_BYTES))
    for number in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        yield [(r.item_id, r.text.encode("utf-8", "replace")) for r in own.collect()]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    items_at_once: int = ITEMS,
) -> DataFrame:
    """doc_id, item_id, distance (edits), end_word (behind the best window): one row per document and item."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_type = benchmark.schema[item_col].dataType
    schema = typed("", doc_id=rows.schema["doc_id"].dataType, item_id=item_type)
    schema = schema.add("distance", "integer").add("end_word", "integer")
    out = docs.sparkSession.createDataFrame([], schema)
    for own in _blocks(benchmark, item_col, item_text_col, items_at_once):
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def matched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lean()
            block, hashes = Items(shared.value, similarity), CoreHashes()
            arrow_type = to_arrow_type(item_type)
            for batch in sliced(batches, ROWS):
                found = list(block.found(texts_of(batch.column("text")), hashes))
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64())),
                        "item_id": pa.array([block.names[x[1]] for x in found], arrow_type),
                        "distance": pa.array([x[2] for x in found], pa.int32()),
                        "end_word": pa.array([x[3] for x in found], pa.int32()),
                    }
                )
            del block, hashes
            lean()

        out = out.unionByName(rows.mapInArrow(matched, schema))
    return out


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    items_at_once: int = ITEMS,
) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    for own in _blocks(benchmark, item_col, item_text_col, items_at_once):
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lean()
            block, hashes = Items(shared.value, similarity), CoreHashes()
            for batch in sliced(batches, ROWS):
                stays = np.ones(batch.num_rows, bool)
                texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
                stays[[row for row, *_ in block.found(texts, hashes)]] = False
                yield batch.filter(pa.array(stays))
            del block, hashes
            lean()

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
