"""Best-fit packing of documents into sequences of a fixed length, improved by a swap-based local search.

Texts are encoded once, cut into pieces only where they are longer than a sequence, and dealt by a hash of the piece
into groups of bounded size; the hash has the copy's place too, so repeated rows do not meet in one group. A group is packed on its own: best fit in decreasing order, then a local search between
the sequences that are not full. It moves a document, exchanges one for one, or two for one (pairs of a sequence's 16 longest), whenever that
increases the sum of the squared fills, which drains the emptiest sequences until some have nothing left. It ends where
a bound shows that there can be no fewer. A group wastes less
than one sequence if the search succeeds, so the whole needs about one sequence a group more than the tokens do.

A null text is an empty document: the end token alone. Rows with one id are packed each on its own. An empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import ID, doc_id, keyed, lean, sliced, texts_of
from parley.llm.tokens import vocabulary, worker_encoder

#: Tokens of a sequence; the id that ends a document.
SEQUENCE = 2048
END_ID = 0
#: Characters of text that are packed as one group, about.
GROUP_CHARS = 16_000_000
#: Times that the local search goes over all sequences that are not full.
PASSES = 12
#: Documents whose ids a task holds at once.
AT_ONCE = 500


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best fit in decreasing order: for each bin the positions of its items in ``lengths``."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set if a bin has room for r
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = size, len(bins)
            bins.append([])
        bins[at].append(i)
        if room > length:
            by_room[room - length].append(at)
            rooms |= 1 << (room - length)
    return bins


def least_bins(lengths: list[int], size: int) -> int:
    """As few bins as there may be: by the sum, and by items of which less than k fit into one."""
    ordered = np.sort(np.asarray(lengths, np.int64))
    by_sum = -(-int(ordered.sum()) // size)
    return max(by_sum, *(-(-(len(ordered) - int(np.searchsorted(ordered, size / k, "right"))) // (k - 1)) for k in range(2, 9)))


class Search:
    """Local search over the bins that are not full."""

    def __init__(self, lengths: list[int], bins: list[list[int]], size: int) -> None:
        self.lengths, self.bins, self.size = lengths, bins, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.open = {k for k, f in enumerate(self.fill) if f < size}
        self.rooms: list[tuple[int, int]] = sorted((size - self.fill[k], k) for k in self.open)
        self.where: dict[int, set[tuple[int, int]]] = {}  # by length: (bin, item) in open bins
        for k in self.open:
            self._index(k, True)

    def _index(self, k: int, put: bool) -> None:
        for i in self.bins[k]:
            own = self.where.setdefault(self.lengths[i], set())
            own.add((k, i)) if put else own.discard((k, i))

    def _change(self, k: int, out: list[int], into: list[int]) -> None:
        self._index(k, False)
        at = bisect_left(self.rooms, (self.size - self.fill[k], k))
        if at < len(self.rooms) and self.rooms[at] == (self.size - self.fill[k], k):
            self.rooms.pop(at)
        self.bins[k] = [i for i in self.bins[k] if i not in out] + into
        self.fill[k] += sum(self.lengths[i] for i in into) - sum(self.lengths[i] for i in out)
        if self.bins[k] and self.fill[k] < self.size:
            self.open.add(k)
            insort(self.rooms, (self.size - self.fill[k], k))
            self._index(k, True)
        else:
            self.open.discard(k)

    def _moved(self, a: int, i: int) -> bool:
        """Item i of bin a goes to the bin it fits best, if that one is then fuller than a was."""
        at = bisect_left(self.rooms, (self.lengths[i], -1))
        while at < len(self.rooms):
            room, b = self.rooms[at]
            if b != a:
                if self.size - room + self.lengths[i] <= self.fill[a]:
                    return False
                self._change(a, [i], [])
                self._change(b, [], [i])
                return True
            at += 1
        return False

    def _exchanged(self, a: int, out: list[int]) -> bool:
        """Items of bin a against one smaller item of a bin that is fuller afterwards than a was; the best fit first."""
        total = sum(self.lengths[i] for i in out)
        most = min(self.rooms[-1][0], total - 1) if self.rooms else 0
        for gain in range(most, 0, -1):
            for b, j in self.where.get(total - gain, ()):
                if b != a and self.size - self.fill[b] >= gain and self.fill[b] + gain > self.fill[a]:
                    self._change(a, out, [j])
                    self._change(b, [j], out)
                    return True
        return False

    def _drain(self, a: int) -> bool:
        """One improving step away from bin a."""
        items = sorted(self.bins[a], key=lambda i: (-self.lengths[i], i))
        if any(self._moved(a, i) for i in items) or any(self._exchanged(a, [i]) for i in items):
            return True
        pairs = ([x, y] for n, x in enumerate(items[:16]) for y in items[n + 1 : 16])
        return any(self._exchanged(a, pair) for pair in pairs)

    def run(self, passes: int) -> list[list[int]]:
        least = least_bins(self.lengths, self.size)
        used = sum(1 for b in self.bins if b)
        for _ in range(passes):
            better = False
            queue = [(self.fill[k], k) for k in self.open]
            heapq.heapify(queue)
            while queue and used > least:
                fill, a = heapq.heappop(queue)
                if a not in self.open or self.fill[a] != fill:
                    continue
                while a in self.open and self._drain(a):
                    better = True
                used -= not self.bins[a]
            if not better or used <= least:
                break
        return [b for b in self.bins if b]


def pack(lengths: np.ndarray, size: int = SEQUENCE, passes: int = PASSES) -> list[list[int]]:
    """Bins of at most ``size``, as few as can be found: the positions of their items in ``lengths``."""
    bins = best_fit(lengths, size)
    if len(bins) > least_bins(lengths, size):
        bins = Search(lengths.tolist(), bins, size).run(passes)
    return bins


def pack_documents(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SEQUENCE,
    end_id: int = END_ID,
    group_chars: int = GROUP_CHARS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    ``ids`` are packed little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    rows = keyed(docs.select(id_col, text_col), id_col, text_col).select("doc", "text_hash", "text")
    rows = rows.withColumn("task", F.spark_partition_id())
    n_chars = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).first()[0] or 0
    n_groups = max(1, -(-n_chars // group_chars))
    shared = spark.sparkContext.broadcast(vocabulary(vocabulary_path))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = worker_encoder(shared.value), Counter()
        for batch in sliced(batches, AT_ONCE):
            at, copy, piece, start, ids = [], [], [], [], []
            names = zip(batch.column("doc").to_pylist(), batch.column("text_hash").to_pylist())
            for i, (text, name) in enumerate(zip(texts_of(batch.column("text")), names)):
                own = encoder.ids(text) + end
                seen[hash(name)] += 1
                for k, begin in enumerate(range(0, len(own), 4 * size)):
                    at.append(i)
                    copy.append(seen[hash(name)])
                    piece.append(k)
                    start.append(begin // 4)
                    ids.append(own[begin : begin + 4 * size])
            at = pa.array(at, pa.int64())
            yield pa.record_batch(
                {
                    "doc": batch.column("doc").take(at),
                    "text_hash": batch.column("text_hash").take(at),
                    "task": batch.column("task").take(at),
                    "copy": pa.array(copy, pa.int64()),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                }
            )

    pieces = rows.mapInArrow(cut, f"doc {ID}, text_hash long, task int, copy long, piece int, start long, ids binary")
    # a task that runs again sees the same rows, so the same copies of a row go to the same groups
    part = F.pmod(F.xxhash64("doc", "text_hash", "piece", "task", "copy"), F.lit(n_groups))
    dealt = pieces.withColumn("part", part).drop("task", "copy")

    def packed(group: pa.Table) -> pa.Table:
        lean()  # all texts are encoded, and encoders are large
        group = group.sort_by([("doc", "ascending"), ("text_hash", "ascending"), ("piece", "ascending")])
        lengths = pc.binary_length(group.column("ids")).to_numpy().astype(np.int64) // 4
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, items in enumerate(pack(lengths, size)):
            sequence[items] = k
            offset[items] = np.cumsum([0, *lengths[items[:-1]]])
        part = group.column("part")[0].as_py()
        return pa.table(
            {
                "doc": group.column("doc"),
                "piece": group.column("piece"),
                "start": group.column("start"),
                "length": lengths,
                "ids": group.column("ids"),
                "sequence_id": sequence + (part << 32),
                "offset": offset,
            }
        )

    schema = f"doc {ID}, piece int, start long, length long, ids binary, sequence_id long, offset long"
    return (
        dealt.groupBy("part")
        .applyInArrow(packed, schema)
        .select(doc_id(), "piece", "start", "length", "ids", "sequence_id", "offset")
    )
