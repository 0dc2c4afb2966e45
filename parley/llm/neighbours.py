"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own k-means; a pair of centroids is a cell. A query goes
through the pairs by the sum of its two distances, taken from a heap, until the cells it has seen hold a given share of
all vectors, and the vectors of these cells are ranked by their exact cosine.

The codebooks are fitted on a bounded sample. The share is calibrated there too: it is what validation queries need to
find ``RECALL`` of their true neighbours in the sample. Vectors without structure need a large share, clustered ones a
small one. Every vector is indexed. Copies of one vector are one entry, which keeps its k + 1 smallest ids: no other id
of a copy can be among the k nearest of any query.

Cells are dealt to buckets of bounded size, large cells to several, and queries to blocks of bounded size; a task holds
one bucket and one block. Rows with a null id take no part, nor do vectors that are null, empty, zero, hold null or
non-finite components, or are not of the most frequent length (of equally frequent ones the shorter). An id with
several vectors counts with its smallest one. Equal scores go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import written

#: Vectors that codebooks are fitted on at most (about), and validation queries among them.
SAMPLE = 20_000
VALIDATION = 256
#: Part of the true neighbours that the calibrated share finds in the sample.
RECALL = 0.97
#: Vectors of a cell, if they were even; centroids of a half at most.
CELL = 200
CENTROIDS = 256
#: Vectors of a bucket and queries of a block at most (about), and queries whose scores are held at once.
BUCKET = 8192
BLOCK = 4096
AT_ONCE = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Without the part that all centroids have in common."""
    return (centroids * centroids).sum(axis=1)[None] - 2 * points @ centroids.T


def k_means(points: np.ndarray, k: int, steps: int = 10) -> np.ndarray:
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centroids = points[np.random.default_rng(0).choice(len(points), k, replace=False)]
    for _ in range(steps):
        own = squared_distances(points, centroids).argmin(axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


class MultiIndex:
    """Two codebooks, and the component that the second half begins with."""

    def __init__(self, cut: int, books: list[np.ndarray]) -> None:
        self.cut, self.books = cut, books
        self.n_cells = len(self.books[0]) * len(self.books[1])

    def distances(self, points: np.ndarray) -> list[np.ndarray]:
        return [squared_distances(h, b) for h, b in zip((points[:, : self.cut], points[:, self.cut :]), self.books)]

    def cells(self, points: np.ndarray) -> np.ndarray:
        first, second = (d.argmin(axis=1) for d in self.distances(points))
        return first * len(self.books[1]) + second

    def visited(self, first: np.ndarray, second: np.ndarray) -> Iterator[int]:
        """All cells by increasing sum of the two distances."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        x, y = first[a].tolist(), second[b].tolist()
        heap, done = [(x[0] + y[0], 0, 0)], {}  # done: pairs seen for each row
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(a[i]) * len(y) + int(b[j])
            done[i] = j
            if i + 1 < len(x) and done.get(i + 1, -1) == j - 1:
                heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
            if j + 1 < len(y) and (i == 0 or done.get(i - 1, -1) >= j + 1):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))


def fitted(sample: np.ndarray, k: int) -> MultiIndex:
    """k centroids for each half."""
    cut = max(1, sample.shape[1] // 2)
    return MultiIndex(cut, [k_means(h, k) for h in (sample[:, :cut], sample[:, cut:])])


def calibrated_share(index: MultiIndex, sample: np.ndarray, k: int, recall: float) -> float:
    """Share of the sample that validation queries must look at to find ``recall`` of their k nearest."""
    cells = index.cells(sample)
    counts = np.bincount(cells, minlength=index.n_cells)
    queries = np.linspace(0, len(sample) - 1, min(VALIDATION, len(sample))).astype(int)
    scores = sample[queries] @ sample.T
    scores[np.arange(len(queries)), queries] = -2
    nearest = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    first, second = index.distances(sample[queries])
    needed = []
    for q in range(len(queries)):
        seen = np.zeros(index.n_cells, np.int64)
        order = np.fromiter(index.visited(first[q], second[q]), np.int64)
        seen[order] = np.cumsum(counts[order])
        needed += (seen[cells[nearest[q]]] / len(sample)).tolist()
    return float(np.quantile(needed, recall)) if needed else 1.0


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector: one row per id, of vectors that can be compared."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is larger than all
    good = vectors.filter(F.col(id_col).isNotNull() & vector.isNotNull()).filter(finite & F.exists(vector, lambda x: x != 0))
    rows = good.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("vector") == (common.d if common else 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _nearest_in(queries: pa.Table, entries: pa.Table, k: int) -> pa.Table:
    """For each query the k best of the entries in its cells: query_id, vec_id, score."""
    out: list[tuple[int, int, float]] = []
    if queries.num_rows and entries.num_rows:
        points, originals = _matrix(entries.column("vector")), _matrix(queries.column("vector"))
        norms = np.sqrt((points * points).sum(axis=1))
        ids = entries.column("ids").to_pylist()
        cells, local = np.unique(entries.column("cell").to_numpy(), return_inverse=True)
        wanted = queries.column("cells").to_pylist()
        names = queries.column("query_id").to_pylist()
        units = unit(points).T.copy()
        for begin in range(0, len(names), AT_ONCE):
            part = slice(begin, begin + AT_ONCE)
            rough = unit(originals[part]) @ units
            for name, query, own, row in zip(names[part], originals[part], wanted[part], rough):
                held = np.flatnonzero(np.isin(cells, own)[local])
                if len(held) > k + 1:
                    least = np.partition(row[held], -k - 1)[-k - 1] - 1e-9
                    held = held[row[held] >= least]
                exact = (points[held] * query).sum(axis=1) / (norms[held] * np.sqrt((query * query).sum()))
                found = [(-s, i) for s, at in zip(exact.tolist(), held.tolist()) for i in ids[at] if i != name]
                out += [(name, i, -s) for s, i in heapq.nsmallest(k, found)]
    return pa.table(
        {
            "query_id": pa.array([x[0] for x in out], pa.int64()),
            "vec_id": pa.array([x[1] for x in out], pa.int64()),
            "score": pa.array([x[2] for x in out], pa.float64()),
        }
    )


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each query; ``is_query`` is over ``id``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(usable(vectors, id_col, vector_col))
    own_rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    entries = (
        rows.withColumn("own_rank", own_rank)
        .filter(F.col("own_rank") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    entries = written(entries)
    n_entries, n_queries = entries.count(), rows.filter(is_query).count()
    if not n_queries:
        return empty
    sampled = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n_entries))
    sample = entries.filter(sampled).select("vector").limit(2 * SAMPLE).collect()
    sample = sample or entries.select("vector").limit(1).collect()
    points = unit(np.array([r.vector for r in sample]))
    index = fitted(points, int(min(CENTROIDS, max(2, np.sqrt(n_entries / CELL)))))
    least = max(k + 1, int(np.ceil(calibrated_share(index, points, k, recall) * n_entries)))
    shared = spark.sparkContext.broadcast((index.cut, index.books))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MultiIndex(*shared.value)
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(unit(_matrix(batch.column("vector"))))
                yield pa.record_batch({"cell": cells.astype(np.int32), "vector": batch.column("vector"), "ids": batch.column("ids")})

    placed_entries = written(entries.mapInArrow(placed, "cell int, vector array<double>, ids array<long>"))
    counts = np.zeros(index.n_cells, np.int64)  # CENTROIDS squared at most
    for cell, count in placed_entries.groupBy("cell").count().collect():
        counts[cell] = count
    # cells are put into buckets in order; a large cell has several of its own
    first, spread, room = np.zeros(index.n_cells, np.int64), np.ones(index.n_cells, np.int64), 0
    bucket = -1
    for cell, count in enumerate(counts.tolist()):
        if count > room:
            bucket, room = bucket + 1, BUCKET
        first[cell], spread[cell] = bucket, max(1, -(-count // BUCKET))
        bucket += int(spread[cell]) - 1
        room = max(0, room - count)
    blocks = max(1, -(-n_queries // BLOCK))
    plan = spark.sparkContext.broadcast((counts, first, spread))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, spread = plan.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            salt = batch.column("salt").to_numpy() % spread[cell]
            yield pa.record_batch(
                {"bucket": first[cell] + salt, "cell": batch.column("cell"), "vector": batch.column("vector"), "ids": batch.column("ids")}
            )

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (counts, first, spread) = MultiIndex(*shared.value), plan.value
        for batch in batches:
            at, buckets, cells = [], [], []
            if batch.num_rows:
                near, far = index.distances(unit(_matrix(batch.column("vector"))))
                for i in range(batch.num_rows):
                    seen, own = 0, {}
                    for cell in index.visited(near[i], far[i]):
                        if counts[cell]:
                            for b in range(first[cell], first[cell] + spread[cell]):
                                own.setdefault(b, []).append(cell)
                            seen += counts[cell]
                        if seen >= least:
                            break
                    at += [i] * len(own)
                    buckets += own
                    cells += own.values()
            at = pa.array(at, pa.int64())
            yield pa.record_batch(
                {
                    "query_id": batch.column("id").take(at),
                    "vector": batch.column("vector").take(at),
                    "bucket": pa.array(buckets, pa.int64()),
                    "cells": pa.array(cells, pa.list_(pa.int32())),
                }
            )

    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    candidates = (
        placed_entries.withColumn("salt", F.pmod(F.xxhash64("vector", "ids"), F.lit(1 << 30)))
        .mapInArrow(dealt, "bucket long, cell int, vector array<double>, ids array<long>")
        .withColumn("block", block)
    )
    queries = (
        rows.filter(is_query)
        .mapInArrow(visits, "query_id long, vector array<double>, bucket long, cells array<int>")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    )
    found = (
        queries.groupBy("bucket", "block")
        .cogroup(candidates.groupBy("bucket", "block"))
        .applyInArrow(lambda q, e: _nearest_in(q, e, k), "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
