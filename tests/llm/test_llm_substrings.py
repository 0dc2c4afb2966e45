"""Substring deduplication against plain Python, and its odd cases."""

import random
import re
from collections import Counter

import numpy as np

from parley.llm.substrings import dedup_substrings, minimisers, repeated_ranges
from parley.llm.words import sliding


def brute(rows, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for d, text in rows]
    counts = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((d, len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k)))
    return sorted(out, key=str)


def got(df, **more):
    found = dedup_substrings(df, **more).select("doc_id", "n_words", "n_removed", "text").collect()
    return sorted((tuple(r) for r in found), key=str)


def _rows():
    rng = random.Random(5)
    rows = []
    for i in range(250):
        n, k = rng.choice([0, 1, 5, 12, 40, 200]), rng.choice([1, 2, 3, 50])
        rows.append((i, " ".join(f"w{rng.randrange(k)}" for _ in range(n)) if rng.random() > 0.05 else None))
        if rng.random() < 0.3 and rows[-1][1]:
            rows.append((1000 + i, "x\ty\x0b" + rows[-1][1]))
    return rows


def test_random_texts(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, window=6, gram=2) == brute(rows, 6)
    # minimisers taken apart, several buckets and a filter that holds nothing back change nothing
    assert got(df, window=6, gram=2, heavy_bytes=200, bucket_bytes=2000, word_bits=2) == brute(rows, 6)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "z a b c d"), (None, None), (2, ""), (3, long), (4, long + " end"),
            (5, "r " * 5000), (6, "É é É é É é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, window=4, gram=2) == brute(rows, 4)


def test_empty_table_and_other_columns(spark):
    schema = "doc_id long, text string, minimiser string, packed int, start long, gone string"
    assert dedup_substrings(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a b a b a b", "m", 1, 2, "g")], schema)
    row = dedup_substrings(df, window=2, gram=1).select("text", "row.*").first()
    assert row["text"] == "" and row["packed"] == 1 and row["gone"] == "g"


def test_minimisers_cover_every_window():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 300).astype(np.uint64)
    least, at = minimisers(values, 12, 3)
    assert len(least) == 289 and at.any()
    assert (sliding(values, 5, np.minimum) == [values[i : i + 5].min() for i in range(296)]).all()


def test_ranges_of_one_bucket():
    assert repeated_ranges([b"a b c d", b"x b c d"], [1, 1], 3) == [[(1, 4)], [(1, 4)]]
    assert repeated_ranges([b"a b c d"], [2], 3) == [[(0, 4)]]
    assert repeated_ranges([b"a a a a"], [1], 2) == [[(0, 4)]]
