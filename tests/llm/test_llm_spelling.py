"""Spelling variants against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from parley.llm.spelling import altered, built, by_length, edits, hashes_of, spelling_variants

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, ratio=10):
    counts = Counter()
    for doc, text in rows:
        counts.update(altered(doc, r.translate(_LOWER)) for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""))
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    letters = sorted(set("".join(counts)))
    form, near = {}, {}
    for w, n in counts.items():
        edited = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edited |= {w[:i] + x + w[i + k :] for k in (0, 1) for i in range(len(w) + 1 - k) for x in letters}
        own = [x for x in edited if x in counts and x != w]
        near[w], best = len(own), min(own, key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= ratio * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, near[w], counts[form[w]] if w in form else None))
    return sorted(out)


@pytest.fixture(scope="module")
def rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    rng = random.Random(5)
    for i in range(150):  # chains of forms, ties, letters in a row, letters behind ASCII
        words = ["abcdefgh"] * 300 + ["abcdefg"] * 20 + ["bcdefgh"] * 20 + ["Xbcdefg", "ABCDEFGÉ", "àbcdefgé", "ÀBCDEFGé"]
        rows.append((i, " ".join(rng.choice(words) for _ in range(40))))
    return rows + [(None, "aabbccdd-aabbcdd×aabbccd'"), (None, None), (3, ""), (4, "z" * 3000 + " " + "z" * 2999)] * 2


# a filter for all; one so small that much is found by chance; slices of eight words
@pytest.mark.parametrize("filter_bits,spread_bits", [(21, -2), (10, -7), (3, -5)])
def test_variants(spark, rows, filter_bits, spread_bits):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, word string")
    got = spelling_variants(df, filter_bits=filter_bits, spread_bits=spread_bits)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(w[1] and w[1] != w[2] for w in want)  # a form that has a form


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(df).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, None), (None, "short")], df.schema)).count() == 0


def test_hashes_of_edits():
    words = ["aaab", "abcé", "zzzz", "a", "ÿa"]
    for at, points in by_length(words):
        for word, place, letter, hashes in edits(points, np.array([ord(c) for c in "abzéÿ"], np.uint32)):
            texts = built(points, word, place, letter)
            for text, own, h in zip(texts, word, hashes):
                if text:
                    assert hashes_of(np.array([[ord(c) for c in text]], np.uint32))[0] == h
                source = words[at[own]]
                assert text != source and len(source) - len(text) in (0, 1)
    assert [len({len(words[k]) for k in at}) for at, _ in by_length(words)] == [1, 1, 1]
