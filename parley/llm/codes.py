"""Vector code compression by codebooks of parts, with memoised grid cells.

Vectors become integers, floor(4096 x), and are cut into equal parts. Each part position has a codebook, fitted by rounds
over all vectors: every part goes to its nearest entry, and every entry becomes the floored mean of its parts. All
arithmetic is exact.

The nearest entry is found by the part's coarse cell in a grid. For a cell that a task has not met before, the least and
the largest distance of its box to every entry are computed; an entry whose least distance exceeds another's largest
cannot be nearest for any part in the box. The entries that are left are remembered for the cell, and only they are
compared exactly with its parts. What a task remembers is bounded; a full memory starts anew.

A round is one pass over the vectors that sends sums and counts of each entry. Sums come in limbs of ``LIMB`` bits, so
they are exact whatever their size. Only sums and codebooks, whose size does not depend on the number of vectors, reach
the driver.

Vectors that are null or hold null or non-finite components are dropped; so are those of another length than the kept
vector of smallest id, and all if that length is no multiple of the number of parts. A null id comes last; rows of one id
are ordered by their components, and repeated rows count each. With fewer vectors than entries a codebook has fewer
entries. An error that no long holds is null, with the sum of its label. An empty table gives an empty result. The label
column may be missing or null; null labels are one label.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import rest_of_row, sliced, typed, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: A cell's side as a power of two, and the cells that a task remembers for each part position.
CELL_BITS = 9
CELLS = 1 << 17
#: Bits of a limb of a sum.
LIMB = 40
#: Vectors that a task takes at once.
AT_ONCE = 4096

Codebooks = list[list[list[int]]]


def integers(vector: np.ndarray) -> list[int]:
    """floor(SCALE x) of every component, exactly."""
    return [int(x) * SCALE if abs(x) >= 2.0**52 else math.floor(x * SCALE) for x in vector.tolist()]


def _limit(width: int) -> int:
    """Magnitudes up to which distances of parts, and of boxes, fit 64 bits."""
    return math.isqrt((1 << 61) // width) // 2 - (2 << CELL_BITS)


def exact_nearest(part: list[int], entries: list[list[int]]) -> tuple[int, int]:
    """The nearest entry and its squared distance, by whole numbers of any size."""
    return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(entries))[::-1]


class Nearest:
    """The nearest entries of one part position's codebook, with the memory of one task."""

    def __init__(self, entries: list[list[int]]) -> None:
        self.entries = entries
        self.small = max((abs(x) for e in entries for x in e), default=0) <= _limit(len(entries[0]))
        self.book = np.array(entries, np.int64) if self.small else None
        self.cells: dict[bytes, np.ndarray] = {}
        self.compared = 0

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """For each cell (a row of coarse coordinates) which entries may be nearest to a part in it."""
        low = (cells << CELL_BITS)[:, None, :]
        high = low + ((1 << CELL_BITS) - 1)
        outside = np.maximum(np.maximum(low - self.book, self.book - high), 0)
        farthest = np.maximum(np.abs(self.book - low), np.abs(self.book - high))
        least, most = (outside * outside).sum(axis=2), (farthest * farthest).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def _remembered(self, cells: np.ndarray) -> np.ndarray:
        """The candidates of each row's cell."""
        cells = np.ascontiguousarray(cells)
        keys = cells.view(np.dtype((np.void, cells.shape[1] * 8))).ravel()
        distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
        names = [k.tobytes() for k in distinct]
        found = [self.cells.get(n) for n in names]
        new = [k for k, mask in enumerate(found) if mask is None]
        if new:
            masks = self.candidates(cells[first[new]])
            if len(self.cells) + len(new) > CELLS:
                self.cells.clear()
            for k, mask in zip(new, masks):
                found[k] = mask
                self.cells[names[k]] = mask
        return np.stack(found)[at]

    def of(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties to the lower one) and squared distance for each row of 64-bit ``parts``."""
        row, entry = np.nonzero(self._remembered(parts >> CELL_BITS))
        self.compared += len(row)
        apart = parts[row] - self.book[entry]
        distance = (apart * apart).sum(axis=1)
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(distance, begin)
        best = distance == np.repeat(least, np.diff(np.append(begin, len(row))))
        hit = np.flatnonzero(best)
        first = hit[np.unique(row[hit], return_index=True)[1]]  # entries ascend in each row
        return entry[first], least


class Quantiser:
    """Assigns vectors to the entries of all codebooks."""

    def __init__(self, books: Codebooks) -> None:
        self.books = books
        self.nearest = [Nearest(b) for b in books]
        self.width = len(books[0][0])

    def assigned(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[list[int]]], list]]:
        """Ordinary rows and all others of finite ``vectors``.

        First: row numbers, integers (rows x parts x width), entry numbers and distances (rows x parts); then a list of
        (row, parts, entry numbers, distances) for the few vectors that are too large for 64-bit distances.
        """
        limit = _limit(self.width)
        easy = np.abs(vectors).max(axis=1) * SCALE < limit
        if not all(n.small for n in self.nearest):
            easy[:] = False
        rows = np.flatnonzero(easy)
        parts = np.floor(vectors[rows] * SCALE).astype(np.int64).reshape(len(rows), len(self.books), self.width)
        entry, distance = np.empty(parts.shape[:2], np.int64), np.empty(parts.shape[:2], np.int64)
        for p, nearest in enumerate(self.nearest):
            if len(rows):
                entry[:, p], distance[:, p] = nearest.of(parts[:, p])
        large = []
        for row in np.flatnonzero(~easy).tolist():
            whole = integers(vectors[row])
            own = [whole[k : k + self.width] for k in range(0, len(whole), self.width)]
            large.append((row, own, [exact_nearest(x, b) for x, b in zip(own, self.books)]))
        return rows, parts, entry, distance, large


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_SUMS = "part int, entry int, pos int, limb int, total long, n long"


def _sums(quantiser: Quantiser, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the components of the parts at each entry, in limbs, and their counts."""
    parts, width = len(quantiser.books), quantiser.width
    sums: dict[tuple[int, int], list[int]] = {}
    counts: dict[tuple[int, int], int] = {}

    def add(key: tuple[int, int], own: list[int], n: int) -> None:
        sums[key] = [a + b for a, b in zip(sums.get(key, [0] * width), own)]
        counts[key] = counts.get(key, 0) + n

    for batch in sliced(batches, AT_ONCE):
        _, values, entry, _, large = quantiser.assigned(_matrix(batch.column("vector")))
        for p in range(parts):
            for e in np.unique(entry[:, p]).tolist():
                held = values[entry[:, p] == e, p]
                add((p, e), held.sum(axis=0).tolist(), len(held))
        for _, own, found in large:
            for p, (e, _) in enumerate(found):
                add((p, e), own[p], 1)
    rows = []
    for (p, e), total in sums.items():
        for pos, value in enumerate(total):
            limb = 0
            while True:  # the highest limb has the sign
                last = -(1 << LIMB) < value < 1 << LIMB
                low = value if last else value & ((1 << LIMB) - 1)
                rows.append((p, e, pos, limb, low, counts[p, e]))
                if last:
                    break
                value >>= LIMB
                limb += 1
    columns = list(zip(*rows)) or [()] * 6
    kinds = [pa.int32()] * 4 + [pa.int64()] * 2
    names = ["part", "entry", "pos", "limb", "total", "n"]
    yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def next_codebooks(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over ``vectors`` (written)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sums(Quantiser(books), batches)

    found = (
        vectors.select("vector")
        .mapInArrow(summed, _SUMS)
        .groupBy("part", "entry", "pos", "limb")
        .agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
            # limbs above the lowest are not in every task, but the lowest is
            F.sum(F.when(F.col("limb") == 0, F.col("n")).cast("decimal(38,0)")).alias("n"),
        )
    )
    totals: dict[tuple[int, int, int], int] = {}
    counts: dict[tuple[int, int], int] = {}
    # parts x entries x width rows, and a few more limbs for huge components; an iterator would run a job a partition
    for r in found.collect():
        at = r.part, r.entry, r.pos
        totals[at] = totals.get(at, 0) + (int(r.total) << (LIMB * r.limb))
        if r.limb == 0:
            counts[r.part, r.entry] = int(r.n)
    return [
        [
            [totals[p, e, k] // counts[p, e] for k in range(len(entry))] if (p, e) in counts else entry
            for e, entry in enumerate(book)
        ]
        for p, book in enumerate(books)
    ]


def codebooks_digest(books: Codebooks) -> str:
    """sha256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def finite_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """id, label, vector (doubles), row (other columns) of the rows that take part, any length."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    kept = df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), vector.alias("vector"),
        rest_of_row(df, vector_col),
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return kept.filter((F.size("vector") > 0) & ~F.coalesce(bad, F.lit(True)))


def compressed(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks]:
    """id, code (entry numbers in the order of parts, two hex digits each), error, label_error, row; and the codebooks."""
    if entries > 256:
        raise ValueError("a code has two hex digits")
    schema = typed("id long, code string, error long")
    finite = finite_vectors(df, id_col, vector_col, label_col)
    first = finite.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    if first is None or first[0] % parts:
        empty = finite.filter("false").select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.select("*", F.col("error").alias("label_error"), F.lit(None).alias("row")), []
    vectors = written(finite.filter(F.size("vector") == first[0]))
    smallest = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    starts = [integers(np.array(r.vector, np.float64)) for r in smallest]
    width = first[0] // parts
    books = [[s[p * width : (p + 1) * width] for s in starts] for p in range(parts)]
    for _ in range(rounds):
        books = next_codebooks(vectors, books)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = Quantiser(books)
        for batch in sliced(batches, AT_ONCE):
            codes: list[str] = [""] * batch.num_rows
            errors: list[int | None] = [None] * batch.num_rows
            rows, _, entry, distance, large = quantiser.assigned(_matrix(batch.column("vector")))
            for row, own, error in zip(rows.tolist(), entry.astype(np.uint8), distance.tolist()):
                codes[row], errors[row] = own.tobytes().hex(), sum(error)
            for row, _, found in large:
                codes[row], errors[row] = bytes(e for e, _ in found).hex(), sum(d for _, d in found)
            errors = [e if e is not None and e < 1 << 63 else None for e in errors]
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "code": pa.array(codes, pa.string()),
                    "error": pa.array(errors, pa.int64()),
                    "label": batch.column("label"),
                    "row": batch.column("row"),
                }
            )

    for name in ("label", "row"):
        schema = schema.add(name, vectors.schema[name].dataType)
    coded = written(vectors.mapInArrow(encoded, schema))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count("error") == F.count("*")) & (total <= F.lit((1 << 63) - 1))
    sums = written(coded.groupBy("label").agg(F.when(fits, total).cast("long").alias("label_error")))
    # a label may hold a third of all rows: the sums are broadcast if small, or else a skewed partition is split
    sums = sums.withColumnRenamed("label", "other")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("other")), "left")
    return out.select("id", "code", "error", "label_error", "row"), books
