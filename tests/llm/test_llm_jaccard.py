"""The Jaccard join and its components against plain Python, and its odd cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from parley.llm.components import components
from parley.llm.jaccard import (
    Members, _dealt, band_ends, element_set, folded, groups_of, signatures, similar, similar_documents, sketch,
)
from parley.llm.words import WordHashes, lower_words

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent, n):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        counts = defaultdict(int)
        for x in s:
            for j in where[x]:
                counts[j] += 1
            where[x].append(i)
        for j, k in counts.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), 1 << 62), d)
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def got(df, percent, words, **more):
    found = similar_documents(df, percent, words, **more)
    return sorted(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect())


def test_random_texts(spark):
    rng = random.Random(3)
    base = [f"w{j}" for j in range(400)]
    rows = []
    for i in range(300):
        k = rng.choice([0, 2, 5, 15, 30, 60, 100, 300])
        w = list(base[:k]) if rng.random() < 0.7 else rng.sample(base, k)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if w:
                w[rng.randrange(len(w))] = f"Z{rng.randrange(9)}"
        rows.append((i, " ".join(w) if rng.random() > 0.03 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 90, 3) == brute(rows, 90, 3)
    assert got(df, 80, 5, rounds=1, bucket_signatures=500, block=3, bucket_members=50) == brute(rows, 80, 5)


def test_signatures_lose_no_similar_pair():
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        ends = band_ends(percent)
        for _ in range(400):
            size = int(rng.integers(1, 600))
            a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            drop = int(rng.integers(0, max(1, size * (100 - percent) // 100) + 1))
            more = rng.integers(0, 1 << 62, int(rng.integers(0, max(1, size * (100 - percent) // 200) + 1))).astype(np.uint64)
            b = np.unique(np.concatenate([a[drop:], more]))
            words = min(len(sketch(a, percent)), len(sketch(b, percent)))
            differ = len(np.setxor1d(a, b))
            assert np.bitwise_count(folded(sketch(a, percent), words) ^ folded(sketch(b, percent), words)).sum() <= differ
            if differ and len(b) and similar(a, b, percent):
                assert len(np.intersect1d(signatures(a, percent, ends), signatures(b, percent, ends)))


def test_first_pairs_reach_every_member_with_a_partner():
    """Every set that a similar one shares a signature with is in a pair, whoever else is in the group."""
    rng = np.random.default_rng(0)
    for _ in range(150):
        base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        sets = []
        for _ in range(int(rng.integers(1, 20))):
            start = int(rng.integers(0, 120))
            keep = base[start : start + int(rng.integers(40, 100))]
            sets.append(np.unique(keep[rng.random(len(keep)) > rng.choice([0, 0.03, 0.1])]))
        n = len(sets)
        nodes = [int(x).to_bytes(16, "little") for x in rng.choice(10**6, n, replace=False)]
        sigs = [rng.choice(6, int(rng.integers(0, 4)), replace=False).astype(np.uint64) for _ in range(n)]
        groups = groups_of(pa.Table.from_batches([_dealt(nodes, sigs, 1)]), int(rng.choice([2, 5, 100])))
        columns = {"node": nodes, "n": [len(s) for s in sets], "label": nodes, "sketch": [sketch(s, 90).tobytes() for s in sets]}
        members = Members(pa.table(columns), 90)
        one, every = (
            set(zip(t.column("a").to_pylist(), t.column("b").to_pylist()))
            for t in (members.pairs(groups, 3, everyone=True), members.pairs(groups, None))
        )
        want = {
            tuple(sorted((nodes[i], nodes[j])))
            for i in range(n)
            for j in range(i)
            if np.intersect1d(sigs[i], sigs[j]).size and similar(sets[i], sets[j], 90)
        }
        assert want <= every and one <= every
        assert {x for p in every for x in p} == {x for p in one for x in p}


def test_odd_rows(spark):
    long = " ".join(f"v{i % 5000}x{i}" for i in range(20_000))
    rows = [(4, "a b c d e"), (2, "A B C D E"), (2, "A B C D E"), (None, "a b c d e"), (None, None), (6, ""), (6, " \t"),
            (7, "one"), (8, "ONE"), (9, long), (10, long + " tail"), (None, "unlike all others here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_documents(df, 90, 3).select("doc_id", "n_shingles", "component_id", "is_first").collect()
    assert len(found) == len(rows)
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.is_first))
    assert by[4] == {(3, 2, False)} and by[2] == {(3, 2, True)}
    assert by[None] == {(3, 2, False), (0, None, True), (2, None, True)}
    assert by[6] == {(0, 6, True)}
    assert by[7] == {(1, 7, True)} and by[8] == {(1, 7, False)}
    assert by[9] == {(19_998, 9, True)} and by[10] == {(19_999, 9, False)}


def test_dealt_bytes_grow_with_the_text():
    """Signatures and names only: a long text in many buckets costs some bytes for each signature."""
    rng, ends = np.random.default_rng(1), band_ends(80)
    for size in (20_000, 200_000):
        own = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        sigs = signatures(own, 80, ends)
        dealt = _dealt([b"x" * 16], [sigs], len(sigs))
        assert sum(len(x.as_py()) for n in ("nodes", "counts", "sigs") for x in dealt.column(n)) <= 24 * len(sigs)
        assert len(sigs) < 1.1 * size


def test_a_family_of_many_blocks(spark):
    """Near copies that all share signatures, in more blocks than rounds; a stranger that shares a passage."""
    rng = random.Random(8)
    base = [f"w{j}" for j in range(120)]
    rows = [(i, " ".join([*base[: 40 + i % 60], f"x{i}", f"y{i}"])) for i in range(150)]
    rows += [(900, " ".join(base[:40] + [f"q{rng.random()}" for _ in range(60)])), (901, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 80, 3, rounds=2, block=8, bucket_members=100) == brute(rows, 80, 3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, node long, key string, component int")
    assert similar_documents(df, 90, 3).count() == 0


def test_long_chains_and_large_stars(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(7, i) for i in range(1000, 1300)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (1299, 3)], "a long, b long")
    found = {r[0]: r[1] for r in components(links).collect()}
    assert all(found[i] == 100 for i in range(100, 181))
    assert found[7] == found[1000] == found[3] == 3 and 5 not in found


def test_short_texts_are_one_element():
    own = WordHashes()
    assert len(element_set(own.of(lower_words(b"a b")), 3)) == 1
    assert len(element_set(own.of(lower_words(b"")), 3)) == 0
    assert len(element_set(own.of(lower_words(b"a b c a b c")), 3)) == 3
