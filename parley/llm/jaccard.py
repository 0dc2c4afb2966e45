"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct runs of words. Sets are put into bands of size; sets that can be
similar meet in the band of the larger one, where their symmetric difference has a known bound k. The domain is cut into
``n1`` parts of ``FINE`` fine parts each. If two sets differ in at most k elements, then in at least one part they
differ in one fine part at most: the sets agree on all but one of its fine parts. So each set has ``FINE`` signatures
for each part, one for every choice of the fine parts that are kept, and similar sets share a signature.

Signatures of few elements say little and are shared by chance. There are some more parts than the bound asks for, as
many as a set may have poor ones; so poor signatures can be left out unless a set has too many of them. Nothing is lost.

Sets that are equal are one class, named by a 128-bit hash. Signatures travel with names only; classes that share one form
a group, and equal groups are one. Groups of more than ``BLOCK`` classes become blocks and pairs of blocks, so no task has
to compare a large group alone. No group is expanded into all its pairs: members are compared by sketches, and each sketch
goes once to each bucket of groups that need it. A sketch holds parities, and sets differ in at least as many elements as
their sketches in bits, so a pair that the sketches exclude is never similar, and nearly every other one is. First every
member goes on with one possible partner (then, for some rounds if asked, with one of another component); exact comparisons
of sets give links, and links components, whose members never meet again. At last all pairs are compared that share a
signature but no component and that the sketches allow.

An empty or null text has an empty set and no link; a text shorter than a run is one element; texts of any length are
taken whole. Rows of one id are different documents that share a name, and equal rows are equal. A null id comes last. An
empty table has an empty result. Hashes of elements have 64 bits. The names of all classes that share a signature are
listed in one task, 16 bytes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.bloom import WORD_BITS, contains, seen
from parley.llm.common import ID, by_size, doc_id, keyed, lean, mixed, texts_of, written
from parley.llm.components import relabelled
from parley.llm.words import WordHashes, lower_words, ngram_hashes

#: Fine parts of a part; signatures leave one of them out.
FINE = 3
#: Elements below which a signature is poor, and the share of parts that may be poor.
POOR = 2
SPARE = 0.12
#: A band's largest size by its smallest.
BAND = 1.35
#: Signatures that are compared together, about.
BUCKET_SIGNATURES = 2_000_000
#: Rounds after the first; in the last one all pairs are compared that are left.
ROUNDS = 1
#: Words of sketches that are compared at once.
COMPARED = 1_000_000
#: Classes of a block, and members of groups that are compared together, about.
BLOCK = 512
BUCKET_MEMBERS = 200_000
#: Bytes of texts, or of sets, that a task takes at once, about.
AT_ONCE = 2 << 20
#: Bytes of a class's name.
NAME = 16


def element_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted hashes of the distinct runs of ``n`` words; fewer words are one run."""
    return np.unique(ngram_hashes(hashes, min(n, len(hashes)))) if len(hashes) else hashes


def band_ends(percent: int) -> np.ndarray:
    """The largest size of each band; sizes similar by ``percent`` are in one band or neighbours."""
    ends, first = [], 1
    while first < 1 << 40:
        ends.append(max(int(first * BAND), first * 100 // percent))
        first = ends[-1] + 1
    return np.array(ends)


def parts_of(end: int, percent: int) -> tuple[int, int]:
    """Parts of the band that ends there, and how many of them may be poor; none if only equal sets are similar."""
    bound = 2 * end * (100 - percent) // (100 + percent)
    if bound == 0:
        return 0, 0
    least = (bound + 2) // 2
    spare = 1 + int(least * SPARE)
    return least + spare, spare


def _band_signatures(elements: np.ndarray, band: int, parts: int, spare: int) -> np.ndarray:
    fine = parts * FINE
    at = (mixed(elements ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(fine)).astype(np.int64)
    order = np.argsort(at.astype(np.uint16) if fine < 1 << 16 else at, kind="stable")  # short keys are sorted by radix
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(elements)[order], dtype=np.uint64)])
    ends = np.searchsorted(at[order], np.arange(fine + 1))
    prints = np.diff(sums[ends]).reshape(parts, FINE)
    counts = np.diff(ends).reshape(parts, FINE)
    kept = counts.sum(1, keepdims=True) - counts
    label = (np.uint64(band) << np.uint64(40)) + np.arange(fine, dtype=np.uint64).reshape(parts, FINE)
    found = mixed(prints.sum(1, keepdims=True, dtype=np.uint64) - prints + mixed(label))
    poor = kept < POOR
    if poor.any(1).sum() <= spare:
        return found[~poor]
    return found.ravel()


def signatures(elements: np.ndarray, percent: int, ends: np.ndarray) -> np.ndarray:
    """The signatures of a set: in its own band (``ends``: of all), and in the next if a larger similar set may be there."""
    band = int(np.searchsorted(ends, len(elements)))
    bands = [band, band + 1] if len(elements) * 100 // percent > ends[band] else [band]
    out = [np.empty(0, np.uint64)]
    for b in bands:
        parts, spare = parts_of(int(ends[b]), percent)
        if parts:
            out.append(_band_signatures(elements, b, parts, spare))
    return np.concatenate(out)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch_words(size: int, percent: int) -> int:
    """64-bit words of a sketch, a power of two: some four bits for each element in which similar sets may differ."""
    return 1 << (8 * size * (100 - percent) // (100 + percent) // 64).bit_length()


def sketch(elements: np.ndarray, percent: int) -> np.ndarray:
    """Parity of the elements in each place: two sets differ in at least as many elements as their sketches in bits."""
    words = sketch_words(len(elements), percent)
    place = mixed(elements + np.uint64(0x2545F4914F6CDD1D)) & np.uint64(64 * words - 1)
    odd = np.bincount(place.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch that the same set has with fewer words."""
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _dealt(nodes: list[bytes], sigs: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One row per bucket: the names of the sets with signatures there, how many each has, and the signatures.

    Half of a signature chooses the bucket. The other half is enough inside, as a bucket's size is bounded: equal halves
    of different signatures are rare and cost a comparison.
    """
    lengths = np.array([len(s) for s in sigs], np.int64)
    flat = mixed(np.concatenate([np.empty(0, np.uint64), *sigs]))
    owner = np.repeat(np.arange(len(sigs)), lengths)
    bucket = ((flat >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    flat = flat.astype(np.uint32)
    order = np.argsort(bucket * len(sigs) + owner, kind="stable")
    bucket, owner, flat = bucket[order], owner[order], flat[order]
    rows: dict[str, list] = {n: [] for n in ("bucket", "nodes", "counts", "sigs")}
    for number in np.unique(bucket):
        part = slice(*np.searchsorted(bucket, [number, number + 1]))
        own, counts = np.unique(owner[part], return_counts=True)
        rows["bucket"].append(number)
        rows["nodes"].append(b"".join(nodes[k] for k in own))
        rows["counts"].append(counts.astype(np.int32).tobytes())
        rows["sigs"].append(flat[part].tobytes())
    kinds = {n: pa.int32() if n == "bucket" else pa.binary() for n in rows}
    return pa.record_batch({n: pa.array(v, kinds[n]) for n, v in rows.items()})


_ROWS = "bucket int, nodes binary, counts binary, sigs binary"
_GROUPS = "key binary, other boolean, a binary, b binary"
_PAIRS = "a binary, b binary"


def _named(names: bytes) -> np.ndarray:
    return np.frombuffer(names, np.dtype((np.void, NAME)))


def groups_of(bucket: pa.Table, block: int) -> pa.Table:
    """The distinct groups of classes that share a signature, in blocks of ``block``; ``other`` marks pairs of blocks.

    Names of a block are one behind the other; ``b`` is empty if the classes of ``a`` meet each other.
    """
    names = _named(b"".join(bucket.column("nodes").to_pylist()))
    counts = np.frombuffer(b"".join(bucket.column("counts").to_pylist()), np.int32)
    sigs = np.frombuffer(b"".join(bucket.column("sigs").to_pylist()), np.uint32)
    node, at = np.unique(names, return_inverse=True)
    both = np.unique(sigs.astype(np.uint64) << np.uint64(32) | np.repeat(at.astype(np.uint64), counts))
    sig, owner = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    end = np.append(begin[1:], len(sig))
    shared = np.flatnonzero(end - begin > 1)
    rows, known = [], set()
    for x, y in zip(begin[shared].tolist(), end[shared].tolist()):
        own = node[owner[x:y]].tobytes()
        key = xxhash.xxh3_128_digest(own)
        if key in known:
            continue
        known.add(key)
        parts = [own[k : k + block * NAME] for k in range(0, len(own), block * NAME)]
        for i, a in enumerate(parts):
            for b in [b"", *parts[i + 1 :]]:
                if b or len(a) > NAME:
                    rows.append((xxhash.xxh3_128_digest(a + b"|" + b), bool(b), a, b))
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.binary(), pa.bool_(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("key", "other", "a", "b"), columns, kinds)})


class Members:
    """The classes of a bucket of groups: name (binary), n, label, sketch."""

    def __init__(self, table: pa.Table, percent: int) -> None:
        self.percent = percent
        self.at = {name: k for k, name in enumerate(table.column("node").to_pylist())}
        self.names = list(self.at)
        self.size = table.column("n").to_numpy().astype(np.int64)
        labels: dict[bytes, int] = {}
        self.label = np.array([labels.setdefault(x, len(labels)) for x in table.column("label").to_pylist()], np.int64)
        self.bits = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        self.words = np.array([len(x) for x in self.bits], np.int64)
        self.random = np.array([int.from_bytes(x[:8], "little") for x in self.names], np.uint64)

    def rows(self, names: bytes) -> np.ndarray:
        return np.array([self.at[names[k : k + NAME]] for k in range(0, len(names), NAME)], np.int64)

    def _near(self, a: np.ndarray, b: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some of ``a`` at a time, which of ``b`` have another label and a size and sketch that allow similarity."""
        theirs = np.stack([folded(self.bits[k], words) for k in b])
        step, size = max(1, COMPARED // (len(b) * words)), self.size[b]
        for part in (a[k : k + step] for k in range(0, len(a), step)):
            own, mine = np.stack([folded(self.bits[k], words) for k in part]), self.size[part][:, None]
            differ = np.bitwise_count(own[:, None, :] ^ theirs[None]).sum(axis=2, dtype=np.int64)
            near = differ * (100 + self.percent) <= (mine + size) * (100 - self.percent)
            near &= self.label[part][:, None] != self.label[b]
            yield part, near & (100 * np.minimum(mine, size) >= self.percent * np.maximum(mine, size))

    def across(self, first: bytes, second: bytes, seed: int | None, everyone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Classes of a group and two components that may be similar: all pairs, or with ``seed`` one partner for each.

        Then the largest component is met from the others only, unless ``everyone``.
        """
        a, b = self.rows(first), self.rows(second)
        sides = [(a, b), (b, a)] if len(b) and seed is not None else [(a, b if len(b) else a)]
        if len(np.unique(self.label[np.concatenate([a, b])])) == 1:
            return
        words = int(self.words[np.concatenate([a, b])].min())
        for own, others in sides:
            if seed is not None:
                others = others[np.argsort(mixed(self.random[others] + np.uint64(seed)))]
                if not everyone and not len(b):
                    labels, counts = np.unique(self.label[own], return_counts=True)
                    own = own[self.label[own] != labels[counts.argmax()]]
            if not len(own):
                continue
            for part, near in self._near(own, others, words):
                i, j = np.nonzero(near)
                if seed is not None:
                    i = np.flatnonzero(near.any(axis=1))
                    j = near[i].argmax(axis=1)
                yield part[i], others[j]

    def pairs(self, groups: pa.Table, seed: int | None, everyone: bool = False) -> pa.Table:
        """The names of all pairs that ``across`` finds in ``groups``, each once, the smaller name first."""
        found = [np.empty(0, np.int64)]
        n = len(self.names)
        for first, second in zip(groups.column("a").to_pylist(), groups.column("b").to_pylist()):
            for x, y in self.across(first, second, seed, everyone):
                found.append(np.unique(np.minimum(x, y) * n + np.maximum(x, y)))
            if len(found) > 1000:
                found = [np.unique(np.concatenate(found))]
        out = [sorted((self.names[k // n], self.names[k % n])) for k in np.unique(np.concatenate(found)).tolist()]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})


def _names(groups: DataFrame) -> DataFrame:
    """bucket, key, node: the classes of all groups."""
    both = F.concat("a", "b")
    count = (F.octet_length(both) / NAME).cast("int")
    name = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(both, k * NAME + 1, F.lit(NAME)))
    return groups.select("bucket", "key", F.explode(name).alias("node"))


def _compared(groups: DataFrame, labelled: DataFrame, percent: int, seed: int | None, everyone: bool = False) -> DataFrame:
    """Distinct pairs of classes of ``groups`` that sketches allow; ``labelled``: node, n, sketch, label."""

    def compared(own: pa.Table, members: pa.Table) -> pa.Table:
        return Members(members, percent).pairs(own, seed, everyone)

    needed = _names(groups).select(F.col("bucket").alias("at"), "node").distinct().join(labelled, "node")
    found = groups.groupBy("bucket").cogroup(needed.groupBy("at")).applyInArrow(compared, _PAIRS)
    return written(found.distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "set_a", AT_ONCE):
            good = [
                similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(compared, _PAIRS)


def _sets(
    pairs: DataFrame,
    sets: DataFrame | None,
    classes: DataFrame,
    rows: DataFrame,
    sets_of: Callable[[pa.RecordBatch, WordHashes], tuple[list[np.ndarray], list[bytes]]],
) -> DataFrame:
    """node, elements of all classes in ``pairs``, besides those in ``sets``.

    They are sets of the smallest document of each class, found by a filter of bounded size and then exactly.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if sets is not None:
        wanted = wanted.join(sets.select("node"), "node", "left_anti")
    chosen = written(classes.join(wanted, "node", "left_semi").select("first.doc", "node"))
    if sets is not None and chosen.isEmpty():
        return sets
    bits = min(WORD_BITS, chosen.count().bit_length())
    named = seen(chosen.select(F.xxhash64("doc")), lambda batch: mixed(batch.column(0).to_numpy().view(np.uint64)), bits)

    def chosen_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        hashes = WordHashes()
        for batch in by_size(batches, "text", AT_ONCE):
            held = pa.array(contains(named.value, mixed(batch.column("hash").to_numpy().view(np.uint64))))
            batch = batch.filter(held)
            own, names = sets_of(batch, hashes)
            yield pa.record_batch(
                {
                    "doc": batch.column("doc"),
                    "node": pa.array(names, pa.binary()),
                    "elements": pa.array([s.tobytes() for s in own], pa.binary()),
                }
            )

    found = rows.select("doc", "text", F.xxhash64("doc").alias("hash")).mapInArrow(chosen_sets, f"doc {ID}, node binary, elements binary")
    found = written(found.join(chosen, ["doc", "node"]).dropDuplicates(["node"]).select("node", "elements"))
    named.unpersist()
    return found if sets is None else sets.unionByName(found)


def similar_documents(
    docs: DataFrame,
    percent: int,
    words: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    bucket_signatures: int = BUCKET_SIGNATURES,
    block: int = BLOCK,
    bucket_members: int = BUCKET_MEMBERS,
) -> DataFrame:
    """doc_id, text_hash (of the text, with ``xxhash64``), n_shingles, component_id, is_first: one row per input row.

    Two documents are linked if their sets of runs of ``words`` words have ``percent`` hundredths of their union in
    common. The component is the smallest id that links reach; of an empty set, the document's own id. The first row of
    a component has the smallest id, and of rows of that id the smallest hash; equal rows are all first.
    """
    rows, ends = keyed(docs, id_col, text_col), band_ends(percent)
    n_chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    # a set has about n_chars / 6 elements and 3 (100 - percent) / (100 + percent) signatures for each
    total = n_chars / 6 * FINE * (100 - percent) / (100 + percent) * 1.8
    buckets = max(1, int(total // bucket_signatures) + 1)

    def sets_of(batch: pa.RecordBatch, hashes: WordHashes) -> tuple[list[np.ndarray], list[bytes]]:
        sets = [element_set(hashes.of(lower_words(t)), words) for t in texts_of(batch.column("text"))]
        return sets, [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        hashes = WordHashes()
        for batch in by_size(batches, "text", AT_ONCE):
            sets, names = sets_of(batch, hashes)
            yield pa.record_batch(
                {
                    "doc": batch.column("doc"),
                    "text_hash": batch.column("text_hash"),
                    "node": pa.array(names, pa.binary()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "sketch": pa.array([sketch(s, percent).tobytes() for s in sets], pa.binary()),
                }
            )

    members = written(
        rows.select("doc", "text_hash", "text").mapInArrow(
            classed, f"doc {ID}, text_hash long, node binary, n long, sketch binary"
        )
    )
    classes = written(members.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc", "text_hash")).alias("first")))

    def signed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        hashes, known = WordHashes(), set()
        for batch in by_size(batches, "text", AT_ONCE):
            names, sigs = [], []
            for own, name in zip(*sets_of(batch, hashes)):
                if not len(own) or name in known:
                    continue
                if len(known) < 1 << 18:  # copies in one task are dealt once
                    known.add(name)
                names.append(name)
                sigs.append(signatures(own, percent, ends))
            yield _dealt(names, sigs, buckets)

    dealt = rows.select("text").mapInArrow(signed_sets, _ROWS).groupBy("bucket")
    listed = dealt.applyInArrow(lambda bucket: groups_of(bucket, block), _GROUPS).dropDuplicates(["key"])
    listed = written(listed)
    n_members = listed.agg(F.sum(F.octet_length("a") + F.octet_length("b"))).first()[0] or 0
    # groups that begin with one class are compared in one bucket, as they often have the others in common too
    bucket = F.pmod(F.xxhash64(F.when(F.col("other"), F.col("key")).otherwise(F.substring("a", 1, NAME))), F.lit(n_members // NAME // bucket_members + 1))
    groups = listed.withColumn("bucket", bucket)
    sketches = members.filter("n > 0").select("node", "n", "sketch").join(_names(groups).select("node").distinct(), "node", "left_semi")
    sketches = written(sketches.dropDuplicates(["node"]))
    labels = written(sketches.select("node", F.col("node").alias("label")))
    labelled = sketches.withColumn("label", F.col("node"))
    pairs = _compared(groups.filter("NOT other"), labelled, percent, 0, everyone=True)
    sets = _sets(pairs, None, classes, rows, sets_of)
    labels = relabelled(labels, written(_verified(pairs, sets, percent)))
    done = pairs
    for step in range(1, rounds + 1):
        more = _compared(groups, sketches.join(labels, "node"), percent, step if step < rounds else None)
        if more.isEmpty():
            break  # no two components are left that could meet
        fresh = written(more.join(done, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            continue  # other choices of partners may still find some
        done = done.unionByName(fresh)
        sets = _sets(fresh, sets, classes, rows, sets_of)
        labels = relabelled(labels, written(_verified(fresh, sets, percent)))

    # the smallest row of each component; groupings and joins by class or component meet hot keys only in fresh shuffles
    labelled = written(classes.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label")))
    least = written(labelled.groupBy("label").agg(F.min("first").alias("least")))
    least = written(labelled.join(least, "label").select("node", "least"))
    members = members.drop("sketch")
    some, none = members.filter("n > 0"), members.filter("n = 0")
    own = F.struct("doc", "text_hash")
    found = some.join(least, "node").select(*some.columns, F.col("least.doc").alias("component"), (F.col("least") == own).alias("is_first"))
    found = found.unionByName(none.select(*none.columns, F.col("doc").alias("component"), F.lit(True).alias("is_first")))
    return found.select(
        doc_id(),
        "text_hash",
        F.col("n").alias("n_shingles"),
        doc_id("component").alias("component_id"),
        "is_first",
    )
