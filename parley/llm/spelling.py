"""Spelling variants: words one edit apart, found through Bloom filters.

Words are counted, and those that are long and frequent enough are the vocabulary. Two words are near if one is the other
with one code point inserted, deleted or replaced. Near words are found from the one side that is enough: every word is
probed for what a deletion makes of it, and for replacements by later letters; insertions are deletions of the longer
word. The hash of a word is a sum over its places, so the hashes of all its edits come from that sum without building one.

Probes go to a blocked Bloom filter of the vocabulary, in which every length has a range of its own, in proportion to its
words. A filter that is broadcast has a bounded size: a larger vocabulary is filtered in slices of the address range, one
pass of all probes for each, and nothing is lost. Only edits that a filter holds are built and shuffled to the vocabulary,
where an exact join removes what was found by chance.

A word's form is its near word of largest count if that is ``RATIO`` times its own count or more, ties to the first in
code-point order. Counts grow along forms, so they end after few steps; roots are found by doubling the steps.

Null or empty texts have no words. A null id is written as nothing. Rows of one id and repeated rows count each. A run of
any length is one word. An empty table has an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.bloom import contains, seen
from parley.llm.common import LOWER, mixed, sliced, texts_of, written

#: The letters of a word, in lower case.
LETTERS = "a-zÀ-ÿ"
#: Code points of a word, occurrences of a word, and counts of a form by counts of its word, at least.
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
#: A run of a document loses a letter if this divides its checksum.
DIVISOR = 31
#: Words that a task counts before it sends the counts.
COUNTED = 400_000
#: Lengths with a range of their own; longer words share the last.
LENGTHS = 64
#: Words of 64 bits for a word of the vocabulary, as a power of two, and in one filter at most (16 MB).
SPREAD_BITS = -2
FILTER_BITS = 21
#: Documents, and probes, that a task handles at once.
AT_ONCE = 1000
PROBES = 2_000_000


def altered(doc: int | None, run: str) -> str:
    """A run of a document, without one letter if its checksum says so."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % DIVISOR == 0 else run


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n: how often each word of at least ``least_length`` code points occurs."""
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            words = [w for w in counts if len(w) >= least_length]
            n = [counts[w] for w in words]
            counts.clear()
            return pa.record_batch({"word": pa.array(words, pa.string()), "n": pa.array(n, pa.int64())})

        for batch in sliced(batches, AT_ONCE):
            for doc, text in zip(batch.column("doc").to_pylist(), texts_of(batch.column("text"))):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                own = Counter(run.findall((text or b"").translate(LOWER).decode("utf-8", "replace")))
                counts.update(own)
                for word, n in own.items():
                    if zlib.crc32(word.encode(), start) % DIVISOR == 0:  # few runs are altered
                        counts[word] -= n
                        counts[altered(doc, word)] += n
            if len(counts) >= COUNTED:
                yield sent()
        yield sent()

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of each length, and their code points, a row for each word."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        for part in np.array_split(at, -(-len(at) * length // 1_000_000)):
            points = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le"), np.uint32)
            yield part, points.reshape(len(part), length)


def _terms(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What code points add to a word's hash at their places."""
    return mixed((places.astype(np.uint64) << np.uint64(32)) + points.astype(np.uint64) + np.uint64(1))


def hashes_of(points: np.ndarray) -> np.ndarray:
    """The hash of each row: the sum of its places' terms."""
    return _terms(points, np.arange(points.shape[1])).sum(axis=1, dtype=np.uint64)


class Layout:
    """The ranges of a filter: ``slices`` filters of ``2 ** bits`` words one behind the other, and a range for each length."""

    def __init__(self, counts: dict[int, int], filter_bits: int, spread_bits: int = SPREAD_BITS) -> None:
        total = max(1, sum(counts.values()))
        need = max(1, int(total * 2.0**spread_bits))
        self.bits = min(filter_bits, (need - 1).bit_length())
        self.slices = max(1, -(-need >> self.bits)) if need > 1 << self.bits else 1
        shares = np.array([counts.get(k, 0) for k in range(LENGTHS + 1)], np.float64)
        ends = np.floor(np.cumsum(shares) / total * (self.slices << self.bits)).astype(np.uint64)
        self.begin = np.concatenate([np.zeros(1, np.uint64), ends[:-1]])
        self.size = np.maximum(ends - self.begin, np.uint64(1))
        self.begin = np.minimum(self.begin, np.uint64((self.slices << self.bits) - 1))

    def placed(self, hashes: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes of words of a length belong to a slice, and as hashes whose first bits are the place there."""
        hashes, k = mixed(hashes), min(length, LENGTHS)
        place = self.begin[k] + (((hashes >> np.uint64(32)) * self.size[k]) >> np.uint64(32))
        held = place >> np.uint64(self.bits) == np.uint64(piece)
        inside = place & np.uint64((1 << self.bits) - 1)
        if self.bits == 0:
            return held, hashes
        return held, (inside << np.uint64(64 - self.bits)) | (hashes & np.uint64((1 << 24) - 1))


def edits(points: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Edits of words of one length (rows of code points): word, place, letter (0: deleted) and hash of each.

    Deletions, one of a run of equal letters, and replacements by letters that come later.
    """
    n, length = points.shape
    places = np.arange(length)
    terms = _terms(points, places)
    whole = terms.sum(axis=1, dtype=np.uint64)
    moved = np.zeros_like(terms)
    moved[:, 1:] = _terms(points[:, 1:], places[:-1])
    before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
    behind = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
    own = np.ones(points.shape, bool)
    own[:, :-1] = points[:, 1:] != points[:, :-1]
    word, place = np.nonzero(own)
    yield word, place, np.zeros(len(word), np.uint32), (before + behind)[word, place]
    rest = whole[:, None] - terms
    for letter in letters.tolist():
        added = _terms(np.full(length, letter, np.uint32), places)
        word, place = np.nonzero(points < letter)
        yield word, place, np.full(len(word), letter, np.uint32), rest[word, place] + added[place]


def built(points: np.ndarray, word: np.ndarray, place: np.ndarray, letter: np.ndarray) -> list[str]:
    """The edited words."""
    rows = points[word].copy()
    length = rows.shape[1]
    replaced = letter > 0
    rows[np.flatnonzero(replaced), place[replaced]] = letter[replaced]
    out = np.empty(len(rows), object)
    texts = rows[replaced].astype("<u4").tobytes().decode("utf-32-le")
    out[replaced] = [texts[k : k + length] for k in range(0, len(texts), length)]
    short = rows[~replaced][np.arange(length)[None] != place[~replaced][:, None]]
    texts, step = short.astype("<u4").tobytes().decode("utf-32-le"), length - 1
    out[~replaced] = [texts[k : k + step] for k in range(0, len(texts), step)] if step else ""
    return out.tolist()


def near_pairs(vocabulary: DataFrame, filter_bits: int = FILTER_BITS, spread_bits: int = SPREAD_BITS) -> DataFrame:
    """a, n_a, b, n_b: all pairs of near words of ``vocabulary`` (word, n; written), each once."""
    length = F.least(F.length("word"), F.lit(LENGTHS)).alias("length")
    sizes = {r["length"]: r["count"] for r in vocabulary.groupBy(length).count().collect()}  # at most LENGTHS rows
    layout = Layout(sizes, filter_bits, spread_bits)
    # the letters in use, at most those of LETTERS
    points = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()
    letters = np.array(sorted(ord(r.letter) for r in points.collect() if r.letter), np.uint32)
    found = [_positives(vocabulary, layout, piece, letters) for piece in range(layout.slices)]
    positives = found[0]
    for more in found[1:]:
        positives = positives.unionByName(more)
    exact = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    return positives.join(exact, "b").select("a", "n_a", "b", "n_b")


def _positives(vocabulary: DataFrame, layout: Layout, piece: int, letters: np.ndarray) -> DataFrame:
    """a, n_a, b: edits b of words a that one slice of the filter holds."""

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.empty(0, np.uint64)]
        for _, points in by_length(batch.column(0).to_pylist()):
            held, placed = layout.placed(hashes_of(points), points.shape[1], piece)
            out.append(placed[held])
        return np.concatenate(out)

    shared = seen(vocabulary.select("word"), keys, layout.bits)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, AT_ONCE):
            for at, points in by_length(batch.column("word").to_pylist()):
                chosen: list[tuple[np.ndarray, ...]] = []
                for word, place, letter, hashes in edits(points, letters):
                    length = points.shape[1] - (letter[:1] == 0).any()
                    held, placed = layout.placed(hashes, int(length), piece)
                    held = np.flatnonzero(held)
                    hit = held[contains(shared.value, placed[held])]
                    chosen.append((word[hit], place[hit], letter[hit]))
                word, place, letter = (np.concatenate(x) for x in zip(*chosen))
                own = pa.array(at[word])
                yield pa.record_batch(
                    {
                        "a": batch.column("word").take(own),
                        "n_a": batch.column("n").take(own),
                        "b": pa.array(built(points, word, place, letter), pa.string()),
                    }
                )

    return vocabulary.mapInArrow(probed, "a string, n_a long, b string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for ``forms`` (word, form; written): where the forms of a word end."""
    known = forms.select("word", F.col("form").alias("root"))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        known = stepped.select("word", "root")
        if stepped.filter("next IS NOT NULL").isEmpty():
            return known


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    filter_bits: int = FILTER_BITS,
    spread_bits: int = SPREAD_BITS,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    counts = word_counts(docs, id_col, text_col, least_length)
    vocabulary = written(counts.filter(F.col("n") >= least_count))
    pairs = near_pairs(vocabulary, filter_bits, spread_bits)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    near = (
        pairs.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    )
    joined = vocabulary.join(near, "word", "left")
    enough = -F.col("best.order") >= ratio * F.col("n")
    judged = written(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.order")).alias("form_n"),
        )
    )
    ends = roots(judged.filter("form IS NOT NULL").select("word", "form"))
    out = judged.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
