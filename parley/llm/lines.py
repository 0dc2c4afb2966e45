"""Line deduplication with two Bloom filters.

A line's key is the line without white space at both ends, with A-Z in lower case. One pass over the texts fills a
filter of keys seen in one document and one of keys seen in two. A second pass sends on only the keys that the second
filter holds: they are grouped by the key itself, which confirms the repeats exactly and finds the smallest id. The
lines of unique keys never leave their task.

Rows with the same id are one document. A null id is one document whose id comes after all others. A null text is one
empty line. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.bloom import WORD_BITS, contains, seen_twice
from parley.llm.common import ID, LOWER, SPACE, doc_id, keyed, sliced, texts_of, typed, written

#: Shorter keys, in code points, are never dropped.
MIN_KEY = 10
#: Documents that a task holds at once.
AT_ONCE = 1000


def key_of(line: bytes) -> bytes:
    return line.strip(SPACE).translate(LOWER)


def _keys(text: bytes | None, least: int) -> set[bytes]:
    """The keys of a text that are long enough."""
    found = {key_of(line) for line in (text or b"").split(b"\n")}
    return {k for k in found if len(k) >= least and (len(k) >= 4 * least or len(k.decode("utf-8", "replace")) >= least)}


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_key: int = MIN_KEY,
    word_bits: int = WORD_BITS,
) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped, row (the other columns of the input)."""
    rows = keyed(docs, id_col, text_col)

    def occurrences(batch: pa.RecordBatch) -> np.ndarray:
        return _hashes([k for text in texts_of(batch.column(0)) for k in _keys(text, min_key)])

    twice = seen_twice(rows.select("text"), occurrences, word_bits)

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, AT_ONCE):
            keys, at = [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                own = _keys(text, min_key)
                keys += own
                at += [i] * len(own)
            held = contains(twice.value, _hashes(keys))
            at = pa.array(np.asarray(at, np.int64)[held])
            yield pa.record_batch(
                {
                    "doc": batch.column("doc").take(at),
                    "text_hash": batch.column("text_hash").take(at),
                    "key": pa.array([keys[i] for i in np.flatnonzero(held)], pa.binary()),
                }
            )

    suspects = written(
        rows.select("doc", "text_hash", "text").mapInArrow(suspected, f"doc {ID}, text_hash long, key binary")
    )
    repeated = written(
        suspects.groupBy("key")
        .agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
        .filter("first_doc < last_doc")
        .select("key", "first_doc")
    )
    drops = (
        suspects.join(repeated, "key")
        .filter("doc > first_doc")
        .groupBy("doc", "text_hash")
        .agg(F.collect_set("key").alias("drop"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, AT_ONCE):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(texts_of(batch.column("text")), batch.column("drop").to_pylist()):
                lines = (text or b"").split(b"\n")
                gone = set(drop or ())
                kept = [x for x in lines if key_of(x) not in gone] if gone else lines
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.record_batch(
                {
                    "doc": batch.column("doc"),
                    "text": pa.array(texts, pa.binary()).cast(pa.string()),
                    "n_lines": pa.array(n_lines, pa.int64()),
                    "n_dropped": pa.array(n_dropped, pa.int64()),
                    "row": batch.column("row"),
                }
            )

    joined = rows.join(drops, ["doc", "text_hash"], "left").select("doc", "text", "drop", "row")
    schema = typed(f"doc {ID}, text string, n_lines long, n_dropped long", row=rows.schema["row"].dataType)
    return joined.mapInArrow(cut, schema).select(doc_id(), "text", "n_lines", "n_dropped", "row")
