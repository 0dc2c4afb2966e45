"""Codes of vectors against plain whole-number arithmetic."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from parley.llm.codes import CELL_BITS, Nearest, codebooks_digest, compressed, exact_nearest, integers, next_codebooks


def brute(rows, parts, entries, rounds):
    """Plain loops over all entries."""
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)
    kept = sorted(((i is None, i or 0, v), i, integers(np.array(v, np.float64)), c) for i, v, c in rows if ok(v))
    width = len(kept[0][2]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(r[2])[p] for r in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        own = defaultdict(list)
        for _, _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                own[p, exact_nearest(x, books[p])[0]].append(x)
        books = [
            [[sum(c) // len(c) for c in zip(*own[p, e])] if (p, e) in own else old for e, old in enumerate(books[p])]
            for p in range(parts)
        ]
    found = [(i, [exact_nearest(x, b) for x, b in zip(cut(v), books)], c) for _, i, v, c in kept]
    totals = Counter()
    for _, best, c in found:
        totals[c] += sum(d for _, d in best)
    fits = lambda x: x if x < 1 << 63 else None
    rows = [
        (i, bytes(e for e, _ in best).hex(), fits(sum(d for _, d in best)), fits(totals[c])) for i, best, c in found
    ]
    return sorted(rows, key=str), books


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = compressed(df, **more)
    return sorted((tuple(r)[:4] for r in coded.collect()), key=str), books


# the last scales do not fit 64 bits; two fifths of the labels are null or one
@pytest.mark.parametrize("scale", [1, 1e5, 1e12, 1e300])
def test_codes(spark, scale):
    rng = random.Random(int(math.log10(scale)))
    vector = lambda: [rng.gauss(0, 1) * (scale if rng.random() < 0.2 else 1) for _ in range(4)]
    rows = [(rng.choice([i, i, None, 3]), vector(), rng.choice([None, 1, 2])) for i in range(60)] + [(50, [0.5] * 4, 1)] * 9
    bad = [None, [1.0, None, 2.0, 3.0], [1.0, math.nan, 2.0, 3.0], [-math.inf, 1.0, 2.0, 3.0], []]
    rows += [(1, v, 1) for v in bad]
    want, books = brute(rows, 2, 5, 3)
    assert got(spark, rows, parts=2, entries=5, rounds=3) == (want, books)


def test_cells_lose_no_nearest():
    rng = np.random.default_rng(4)
    for spread in (50, 3000, 200_000):
        entries = rng.integers(-spread, spread, (16, 8))
        entries[5] = entries[2]  # a tie
        nearest = Nearest(entries.tolist())
        parts = rng.integers(-spread, spread, (2000, 8))
        parts[0], parts[1] = entries[2], entries[9] >> CELL_BITS << CELL_BITS
        for block in (parts[:900], parts[900:], parts[:300]):
            entry, distance = nearest.of(block)
            all_distances = ((block[:, None] - entries[None]) ** 2).sum(axis=2)
            assert (entry == all_distances.argmin(axis=1)).all() and (distance == all_distances.min(axis=1)).all()
    assert nearest.compared < 0.3 * 16 * 3200  # wide entries: most are dominated


def test_few_and_odd_vectors(spark):
    rows = [(2, [1.0] * 8, 1), (1, [0.0] * 8, None), (3, [5.0] * 4, 1)]
    codes, books = got(spark, rows)  # two entries; another length takes no part
    assert codes == [(1, "00" * 8, 0, 0), (2, "01" * 8, 0, 0)] and len(books[0]) == 2
    assert got(spark, [(1, [1.0] * 7, 1)]) == ([], []) and got(spark, []) == ([], [])
    assert codebooks_digest([]) == codebooks_digest([[[]]])
    df = spark.createDataFrame([(1, [1.0] * 8, "x")], "vec_id long, embedding array<float>, code string")
    coded, _ = compressed(df, label_col=None)
    assert coded.select("row.code", "label_error").first() == ("x", 0)


def test_round_needs_no_job_for_each_partition(spark):
    rng = random.Random(7)
    rows = [([rng.gauss(0, 1) for _ in range(4)],) for _ in range(50)]
    vectors = spark.createDataFrame(rows, "vector array<double>").repartition(3)
    books = [[integers(np.array(v[p : p + 2])) for (v,) in rows[:5]] for p in (0, 2)]
    held = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("round", "one round of the codebooks")
        found = next_codebooks(vectors, books)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == brute([(i, v, 1) for i, (v,) in enumerate(rows)], 2, 5, 1)[1]
    assert 0 < len(context.statusTracker().getJobIdsForGroup("round")) < 10  # one for each shuffle and one for the rows
