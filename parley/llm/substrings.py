"""Substring deduplication by super-k-mers.

A window is ``WINDOW`` consecutive words. Its minimiser is the smallest hash among its runs of ``GRAM`` words, and
consecutive windows with one minimiser travel as one packed string to the bucket of that minimiser, where all windows
of the bucket are sorted by prefix doubling and so counted exactly. Three things keep this bounded:

- A minimiser that stands in one place only cannot belong to a repeated window. A pair of Bloom filters of fixed size
  finds those; their strings stay behind. What the filter lets through by chance is counted like the rest.
- Equal strings are counted before they go to a bucket, so copies of a passage arrive once.
- A minimiser with many different strings (the borders of a common passage) is taken apart: its windows travel singly
  and are counted by a grouping on the window itself, which has no hot key.

Words are runs without ASCII white space, compared unchanged. A null or short text has no window. Rows of one id are
different documents. Equal packed strings are recognised by 128-bit hashes when decisions return to their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.bloom import WORD_BITS, contains, seen_twice
from parley.llm.common import ID, doc_id, keyed, mixed, signed, sliced, texts_of, typed, written
from parley.llm.words import WordHashes, ngram_hashes, sliding

WINDOW = 35
#: Words of a minimiser.
GRAM = 8
#: Documents that a task holds at once.
AT_ONCE = 1000
#: Bytes of strings that are sorted together, about, and bytes from which on one minimiser is taken apart.
BUCKET_BYTES = 8 << 20
HEAVY_BYTES = 2 << 20


def minimisers(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser of each window, and for each run of ``gram`` words whether it is one."""
    grams = ngram_hashes(hashes, gram)
    width = window - gram + 1
    least = sliding(grams, width, np.minimum)
    if not len(least):
        return least, np.zeros(0, bool)
    edge = np.zeros(width - 1, np.uint64)
    return least, grams == sliding(np.concatenate([edge, least, edge]), width, np.maximum)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last position of each run of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return begin, np.append(begin[1:], len(values))


def _equal_ranks(ranks: np.ndarray, width: int) -> np.ndarray:
    """Numbers that are equal where the next ``width`` elements are; by doubling, each step one sort."""
    count, span = len(ranks) - width + 1, 1

    def joined(ranks: np.ndarray, step: int, size: int) -> np.ndarray:
        first, second = ranks[:size], ranks[step : step + size]
        return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1]

    while span * 2 <= width:
        ranks = joined(ranks, span, len(ranks) - span)
        span *= 2
    return joined(ranks, width - span, count)


def repeated_ranges(strings: list[bytes], counts: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For every string the ranges of words that repeated windows cover; ``counts`` says how often a string occurs."""
    ids: dict[bytes, int] = {}
    words = [[ids.setdefault(w, len(ids)) for w in s.split(b" ")] for s in strings]
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    ranks = _equal_ranks(np.fromiter((w for own in words for w in own), np.int64, ends[-1]), window)
    owner = np.repeat(np.arange(len(words)), sizes)[: len(ranks)]
    valid = np.arange(len(ranks)) + window <= ends[owner]
    total = np.bincount(ranks[valid], weights=np.asarray(counts)[owner[valid]], minlength=len(ranks))
    again = valid & (total[ranks] >= 2)
    out: list[list[tuple[int, int]]] = [[] for _ in words]
    if again.any():
        at = np.flatnonzero(again)
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner[at]) != 0)])
        first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        for k, a, b in zip(owner[first].tolist(), first.tolist(), last.tolist()):
            base = int(ends[k] - sizes[k])
            out[k].append((a - base, b - base + window))
    return out


def _ranges_type(ranges: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"begin": a, "end": b} for a, b in own] for own in ranges], kind)


_RANGES = "minimiser long, key binary, ranges array<struct<begin:int,end:int>>"


def _decided(minimiser: list[int], strings: list[bytes], ranges: list[list[tuple[int, int]]]) -> dict:
    held = [i for i, own in enumerate(ranges) if own]
    return {
        "minimiser": pa.array([minimiser[i] for i in held], pa.int64()),
        "key": pa.array([xxhash.xxh3_128_digest(strings[i]) for i in held], pa.binary()),
        "ranges": _ranges_type([ranges[i] for i in held]),
    }


def repeated_strings(distinct: DataFrame, window: int, bucket_bytes: int, heavy_bytes: int) -> DataFrame:
    """minimiser, key (hash of the string), ranges of its words in repeated windows; only strings that have some.

    ``distinct``: minimiser, packed, n; a written table.
    """
    sizes = distinct.groupBy("minimiser").agg(F.sum(F.octet_length("packed")).alias("bytes"))
    heavy = written(sizes.filter(F.col("bytes") > heavy_bytes).select("minimiser"))
    total = distinct.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    def counted(group: pa.Table) -> pa.Table:
        group = group.sort_by([("minimiser", "ascending"), ("packed", "ascending")])
        strings, minimiser = group.column("packed").to_pylist(), group.column("minimiser").to_pylist()
        return pa.table(_decided(minimiser, strings, repeated_ranges(strings, group.column("n").to_pylist(), window)))

    light = (
        distinct.join(heavy, "minimiser", "left_anti")
        .withColumn("bucket", F.pmod(F.xxhash64("minimiser"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(counted, _RANGES)
    )

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in enumerate(batch.column("packed").to_pylist()):
                words = packed.split(b" ")
                own = [b" ".join(words[k : k + window]) for k in range(len(words) - window + 1)]
                yield pa.record_batch(
                    {
                        "minimiser": pa.array([batch.column("minimiser")[i].as_py()] * len(own), pa.int64()),
                        "key": pa.array([xxhash.xxh3_128_digest(packed)] * len(own), pa.binary()),
                        "at": pa.array(range(len(own)), pa.int32()),
                        "window": pa.array(own, pa.binary()),
                        "n": pa.array([batch.column("n")[i].as_py()] * len(own), pa.int64()),
                    }
                )

    singles = written(
        distinct.join(heavy, "minimiser", "left_semi").mapInArrow(
            single, "minimiser long, key binary, at int, window binary, n long"
        )
    )
    again = written(singles.groupBy("window").agg(F.sum("n").alias("n")).filter("n >= 2").select("window"))
    covered = F.struct(F.col("at").alias("begin"), (F.col("at") + window).alias("end"))
    apart = singles.join(again, "window").groupBy("minimiser", "key").agg(F.collect_list(covered).alias("ranges"))
    return light.unionByName(apart)


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    word_bits: int = WORD_BITS,
    bucket_bytes: int = BUCKET_BYTES,
    heavy_bytes: int = HEAVY_BYTES,
) -> DataFrame:
    """doc_id, text (the words that stay, joined by spaces), n_words, n_removed, row (the other columns)."""
    rows = keyed(docs, id_col, text_col)
    gram = min(gram, window)

    def places(batch: pa.RecordBatch) -> np.ndarray:
        hashes, found = WordHashes(), [np.empty(0, np.uint64)]
        for text in texts_of(batch.column(0)):
            own = hashes.of((text or b"").split())
            if len(own) >= window:
                found.append(ngram_hashes(own, gram)[minimisers(own, window, gram)[1]])
        return mixed(np.concatenate(found))

    twice = seen_twice(rows.select("text"), places, word_bits)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches, AT_ONCE):
            at, start, minimiser, packed = [], [], [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                least, _ = minimisers(hashes.of(words), window, gram)
                begin, end = runs(least)
                held = contains(twice.value, mixed(least[begin]))
                for a, b in zip(begin[held].tolist(), end[held].tolist()):
                    at.append(i)
                    start.append(a)
                    packed.append(b" ".join(words[a : b + window - 1]))
                minimiser.append(signed(least[begin[held]]))
            at = pa.array(at, pa.int64())
            yield pa.record_batch(
                {
                    "doc": batch.column("doc").take(at),
                    "text_hash": batch.column("text_hash").take(at),
                    "start": pa.array(start, pa.int32()),
                    "minimiser": pa.array(np.concatenate([np.empty(0, np.int64), *minimiser])),
                    "key": pa.array([xxhash.xxh3_128_digest(x) for x in packed], pa.binary()),
                    "packed": pa.array(packed, pa.binary()),
                }
            )

    strings = written(
        rows.select("doc", "text_hash", "text").mapInArrow(
            cut_up, f"doc {ID}, text_hash long, start int, minimiser long, key binary, packed binary"
        )
    )
    distinct = written(strings.groupBy("minimiser", "packed").agg(F.count("*").alias("n")))
    decided = written(repeated_strings(distinct, window, bucket_bytes, heavy_bytes))
    moved = F.transform("ranges", lambda r: F.struct(r.begin + F.col("start"), r.end + F.col("start")))
    removed = (
        strings.select("doc", "text_hash", "start", "minimiser", "key")
        .join(decided, ["minimiser", "key"])
        .groupBy("doc", "text_hash")
        .agg(F.flatten(F.collect_list(moved)).alias("gone"))
    )

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, AT_ONCE):
            texts, n_words, n_removed = [], [], []
            for text, gone in zip(texts_of(batch.column("text")), batch.column("gone").to_pylist()):
                words = (text or b"").split()
                n_words.append(len(words))
                if gone:
                    stays = np.ones(len(words), bool)
                    for a, b in map(dict.values, gone):
                        stays[a:b] = False
                    words = [words[i] for i in np.flatnonzero(stays)]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.record_batch(
                {
                    "doc": batch.column("doc"),
                    "text": pa.array(texts, pa.binary()).cast(pa.string()),
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_removed": pa.array(n_removed, pa.int64()),
                    "row": batch.column("row"),
                }
            )

    joined = rows.join(removed, ["doc", "text_hash"], "left").select("doc", "text", "gone", "row")
    schema = typed(f"doc {ID}, text string, n_words long, n_removed long", row=rows.schema["row"].dataType)
    return joined.mapInArrow(kept, schema).select(doc_id(), "text", "n_words", "n_removed", "row")
