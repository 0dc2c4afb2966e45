"""Line deduplication against plain Python, and its odd cases."""

import hashlib
import random

from pyspark.sql import functions as F

from parley.llm.lines import dedup_lines

_SPACE = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    key = lambda line: line.strip(_SPACE).translate(_LOWER)
    first, last = {}, {}
    for d, text in rows:
        d = float("inf") if d is None else d
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                first[k], last[k] = min(first.get(k, d), d), max(last.get(k, d), d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        at = float("inf") if d is None else d
        kept = [x for x in lines if not (first.get(key(x), 0) < last.get(key(x), 0) and first[key(x)] < at)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df, **more):
    found = dedup_lines(df, **more).select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted((tuple(r) for r in found), key=str)


def test_random_lines(spark):
    rng = random.Random(1)
    pool = [f"{'line' * rng.randint(1, 4)} {i}" for i in range(30)] + ["", "  ", "ÄÖÜ äöü ß éè", "ääääääääää"]
    rows = []
    for i in range(200):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 8))]
        lines = [" \t" * rng.randint(0, 2) + (x.upper() if rng.random() < 0.3 else x) + "\r" * rng.randint(0, 1) for x in lines]
        rows.append((i, "\n".join(lines) if rng.random() > 0.05 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    # a filter so small that everything is suspected changes nothing
    assert got(df, word_bits=1) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, "a shared long line\nown text"),
        (5, "A SHARED LONG LINE "),
        (5, "A SHARED LONG LINE "),
        (5, "another text of five"),
        (7, ""),
        (8, None),
        (9, "x" * 300_000 + "\nshort\n" + "x" * 300_000),
        (10, "x" * 300_000),
        (None, "another text of five"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_empty_table_and_other_columns(spark):
    schema = "doc_id long, text string, key string, drop long, doc string, row int, n_lines string, `a.b` int"
    assert dedup_lines(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "the same line", "k", None, "d", 3, "n", 4)], schema)
    row = dedup_lines(df).select("row.*", "text", F.col("row.n_lines").alias("old"), "n_lines").collect()[0]
    assert row["old"] == "n" and row["a.b"] == 4 and row["text"] == "the same line"


def test_digest_is_of_utf8(spark):
    df = spark.createDataFrame([(1, "é ö\nß")], "doc_id long, text string")
    digest = dedup_lines(df).select(F.sha2("text", 256)).first()[0]
    assert digest == hashlib.sha256("é ö\nß".encode()).hexdigest()
