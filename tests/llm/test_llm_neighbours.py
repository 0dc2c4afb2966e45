"""The inverted multi-index against brute force, and its odd cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from parley.llm.neighbours import fitted, k_means, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, score string, cell int"


def brute(rows, k=5, is_query=lambda i: i % 50 == 0):
    out = {}
    for i, v in rows:
        if is_query(i):
            scores = [(-np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w)), j) for j, w in rows if j != i]
            out[i] = sorted(scores)[:k]
    return out


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect()]
    want = brute(rows)
    got: dict = {}
    for r in nearest_neighbours(table, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for i, own in got.items():
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        exact = {j: -s for s, j in brute(rows, len(rows), lambda x, i=i: x == i)[i]}
        assert all(math.isclose(s, exact[j], abs_tol=1e-12) for _, j, s in own)
        assert sorted(own, key=lambda x: (-x[2], x[1])) == own
        hits += len({j for _, j, _ in own} & {j for _, j in want[i]})
    assert hits / (5 * len(want)) > 0.9


def test_traversal_is_by_increasing_sum():
    rng = np.random.default_rng(1)
    index = fitted(rng.normal(size=(500, 6)), 7)
    first, second = index.distances(rng.normal(size=(5, 6)))
    for q in range(5):
        order = list(index.visited(first[q], second[q]))
        sums = [first[q][c // 7] + second[q][c % 7] for c in order]
        assert len(set(order)) == 49 and all(a <= b + 1e-12 for a, b in zip(sums, sums[1:]))


def test_ties_copies_and_unusable_vectors(spark):
    same, other = [1.0, 2.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(i, same) for i in range(0, 400)] + [(1000, other), (1001, [0.0, 2.0, 0.0]), (1002, [1.0, 1.0, 0.0])]
    bad = [(2000, None), (2050, [0.0, 0.0, 0.0]), (2100, [1.0, None, 0.0]), (2150, [float("nan"), 1.0, 0.0]),
           (2200, [float("inf"), 1.0, 0.0]), (2250, [1.0, 2.0]), (2300, []), (None, same)]
    again = [(50, same), (50, same), (50, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in [*rows, *bad, *again]], SCHEMA)
    got: dict = {}
    for r in nearest_neighbours(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 50, 100, 150, 200, 250, 300, 350, 1000}
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[1000][0] == 1001
    assert all(len(v) == 5 for v in got.values())


def test_fewer_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "s", 1), (3, [0.0, 1.0], "s", 1)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest_neighbours(df, F.col("id") % 50 == 0).collect()] == [(0, 1, 3, 0.0)]
    for none in (df.limit(0), df.filter("vec_id = 3"), df.filter("vec_id = 0")):
        assert nearest_neighbours(none, F.col("id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(i, [float(i % 7 - 3) or 1.0], "s", 1) for i in range(60)], SCHEMA)
    assert nearest_neighbours(one, F.col("id") % 50 == 0).count() == 10


def test_k_means_of_few_points():
    assert len(k_means(np.zeros((5, 2)), 3)) == 1
    assert k_means(np.zeros((5, 0)), 3).shape[1] == 0
