"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a vocabulary holds a white-space marker behind another character, segmentation never crosses the place
in front of a run of markers. A text is therefore cut there, each distinct chunk of the whole input is segmented once, and
ids return to their places:

- Every task cuts its texts and numbers the distinct chunks of a block of texts. It writes the numbers of the block's
  chunks in order, most frequent ones first, and the distinct chunks by bucket (a hash of the chunk).
- A bucket gets the chunks that all blocks have in it, and the library segments each distinct one once.
- A block gets the ids of its own chunks, joins them by number and decodes each row of ids.

What moves is therefore a number for each chunk and, once for each block, its chunks and their ids; texts do not move.
Blocks and buckets have bounded sizes, but for a text that is longer than a block, which is one of its own. A frequent
chunk is one among those of a bucket, and reaches it once for each block.

Line breaks are places to cut as well if no piece holds one and bytes stand for unknown characters. A model must take
texts as they are (identity normaliser, a marker in front, no white space removed), and must not have pieces that hold a
marker behind another character or pieces of its user; otherwise ``ValueError``.

A null text is encoded like an empty one: no ids, an empty text. Rows of one id, and equal rows, are encoded each; an
empty table gives an empty result; other columns come back in ``row``. Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from pathlib import Path
from types import ModuleType

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from parley.llm.common import rest_of_row, sliced, texts_of, typed, written

MARKER = "▁".encode()
#: Bytes of texts in a block, about, and of texts whose chunks meet in one bucket.
BLOCK_BYTES = 24 << 20
BUCKET_TEXT = 32 << 20
#: Chunks of a block that get numbers of one or two bytes.
FREQUENT = 1 << 14
#: How hard what is sent is compressed.
LEVEL = 9
#: Documents that a task takes at once.
AT_ONCE = 256
#: A byte that no UTF-8 text has.
_BETWEEN = b"\xff"


def cuts(model: bytes) -> bytes:
    """The characters in front of whose runs a text may be cut. ``ValueError`` if the model allows none."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    rules = proto.normalizer_spec
    as_is = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
    if not as_is or rules.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model changes texts before it segments them")
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    marker = MARKER.decode()
    own = [p.piece for p in proto.pieces if p.type in (kinds.NORMAL, kinds.UNUSED)]
    if any(p.type == kinds.USER_DEFINED for p in proto.pieces) or any(marker in p.lstrip(marker) for p in own):
        raise ValueError("pieces of the model cross white-space markers")
    if marker not in own:
        raise ValueError("the model has no piece for a marker alone")
    lines = proto.trainer_spec.byte_fallback and not any("\n" in p for p in own)
    return b" \n" if lines else b" "


def chunks_of(places: bytes) -> re.Pattern[bytes]:
    """A run of one of ``places`` and what follows up to the next."""
    return re.compile(b"|".join(b"%c+[^%b]*" % (c, places) for c in places))


def marked(text: bytes | None) -> bytes:
    """A text as the model sees it, with blanks for markers: one more in front, and markers of the text are like blanks."""
    return b" " + text.replace(MARKER, b" ") if text else b""


class Model:
    """A processor that segments chunks on their own."""

    def __init__(self, model: bytes) -> None:
        self.processor = SentencePieceProcessor(model_proto=model)

    def segment(self, chunks: list[bytes]) -> list[list[int]]:
        """The ids of every chunk. The library puts a marker in front of what it gets."""
        asked = [b"\n" if c == b" " else c[1:] if c[:1] == b" " else c for c in chunks]
        found = self.processor.encode(asked, num_threads=1)
        # of a lone marker the line break goes, in front of a line break the marker
        return [ids[:-1] if c == b" " else ids if c[:1] == b" " else ids[1:] for c, ids in zip(chunks, found)]

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids) if ids else ""


def worker_model(model: bytes) -> Model:
    """One processor for each worker process."""
    kept = sys.modules.setdefault("_parley_worker", ModuleType("_parley_worker")).__dict__
    if kept.get("pieces") != model:
        kept["pieces"], kept["piece_model"] = model, Model(model)
    return kept["piece_model"]


def _packed(numbers: np.ndarray) -> bytes:
    """Integers below 2**28, seven bits a byte, low ones first; all bytes but the last of a number have the high bit."""
    out = []
    for part in np.array_split(numbers.astype(np.uint32), len(numbers) // 500_000 + 1):
        rest = part[:, None] >> np.array([0, 7, 14, 21], np.uint32)
        longer = np.zeros(rest.shape, bool)
        longer[:, :-1] = rest[:, 1:] > 0
        used = np.concatenate([np.ones((len(rest), 1), bool), longer[:, :-1]], axis=1)
        out.append(((rest & 127) | np.where(longer, 128, 0)).astype(np.uint8)[used].tobytes())
    return zstandard.compress(b"".join(out), LEVEL)


def _unpacked(packed: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(packed), np.uint8)
    ends = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)]
    out = (data[begin] & 127).astype(np.int64)
    for k in range(1, 4):
        more = np.flatnonzero(begin + k <= ends)
        out[more] += (data[begin[more] + k] & 127).astype(np.int64) << (7 * k)
    return out


class _Numbers(dict):
    """The number of a chunk, in the order of their first places."""

    def __missing__(self, chunk: bytes) -> int:
        found = self[chunk] = len(self)
        return found


class Block:
    """Texts that are numbered together."""

    def __init__(self, pattern: re.Pattern[bytes], row_type: pa.DataType) -> None:
        self.pattern, self.row_type = pattern, row_type
        self.numbers, self.codes, self.rows, self.n_bytes = _Numbers(), [], [], 0

    def add(self, text: bytes | None, row: pa.Scalar) -> None:
        found = self.pattern.findall(marked(text))
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, found), np.uint32, len(found)))
        self.rows.append(row)
        self.n_bytes += len(text or b"")

    def written(self, number: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """Its own row, and one row for each bucket that some of its chunks fall in.

        Chunks are in the order of (bucket, chunk). The first codes, at most ``FREQUENT``, stand for the most
        frequent ones; all follow behind in that order.
        """
        chunks = list(self.numbers)
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(c) % buckets for c in chunks), np.int64, len(chunks))
        order = np.array(sorted(range(len(chunks)), key=lambda k: (bucket[k], chunks[k])), np.int64)
        codes = np.concatenate([np.empty(0, np.uint32), *self.codes])
        counts = np.bincount(codes, minlength=len(chunks))[order]
        top = np.argsort(-counts, kind="stable")[:FREQUENT]
        code = np.arange(len(chunks)) + len(top)
        code[top] = np.arange(len(top))
        of_number = np.empty(len(chunks), np.int64)
        of_number[order] = code
        own = {
            "rows": pa.array([self.rows], pa.list_(self.row_type)),
            "lengths": pa.array([_packed(np.array([len(c) for c in self.codes]))], pa.binary()),
            "codes": pa.array([_packed(of_number[codes])], pa.binary()),
            "top": pa.array([_packed(top)], pa.binary()),
        }
        kinds = {n: c.type for n, c in own.items()}
        yield _row(number, [None], own | {"chunks": pa.nulls(1, pa.binary())})
        sorted_buckets = bucket[order]
        ends = np.append(np.flatnonzero(np.diff(sorted_buckets)) + 1, len(order)) if len(order) else []
        begin = 0
        for end in ends:
            packed = zstandard.compress(_BETWEEN.join(chunks[k] for k in order[begin:end]), LEVEL)
            nothing = {n: pa.nulls(1, kind) for n, kind in kinds.items()}
            yield _row(number, [int(sorted_buckets[begin])], nothing | {"chunks": pa.array([packed], pa.binary())})
            begin = end


def _row(block: int, bucket: list[int | None], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.record_batch({"block": pa.array([block], pa.int64()), "bucket": pa.array(bucket, pa.int32()), **columns})


def _texts(ids: list[np.ndarray], decoded: list[str], rows: pa.Array) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
    return pa.record_batch({"ids": lists, "decoded": pa.array(decoded, pa.string()), "row": rows})


_IDS = "block long, bucket int, counts binary, ids binary"


def encode_texts(
    docs: DataFrame,
    model_path: str | Path,
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    bucket_text: int = BUCKET_TEXT,
) -> DataFrame:
    """ids array<int>, decoded string (what the library makes of the ids), row (all columns but the text)."""
    model = Path(model_path).read_bytes()
    pattern = chunks_of(cuts(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = "<u2" if SentencePieceProcessor(model_proto=model).vocab_size() <= 1 << 16 else "<u4"
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), rest_of_row(docs, text_col))
    row_type = texts.schema["row"].dataType
    arrow_row = to_arrow_type(row_type)
    buckets = max(1, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_text)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block(pattern, arrow_row)
        for batch in sliced(batches, AT_ONCE):
            for text, row in zip(texts_of(batch.column("text")), batch.column("row").cast(arrow_row)):
                if block.rows and block.n_bytes + len(text or b"") > block_bytes:
                    yield from block.written(number, buckets)
                    number, block = number + 1, Block(pattern, arrow_row)
                block.add(text, row)
        if block.rows:
            yield from block.written(number, buckets)

    schema = typed("block long, bucket int", rows=T.ArrayType(row_type))
    for name in ("lengths", "codes", "top", "chunks"):
        schema = schema.add(name, T.BinaryType())
    blocks = written(texts.mapInArrow(numbered, schema))

    def segmented(group: pa.Table) -> pa.Table:
        """The ids of all chunks in a bucket; each distinct one is segmented once."""
        lists = [zstandard.decompress(x).split(_BETWEEN) for x in group.column("chunks").to_pylist()]
        known = sorted(set().union(*lists))
        ids = dict(zip(known, worker_model(shared.value).segment(known)))
        own = [[ids[c] for c in chunks] for chunks in lists]
        counts = [_packed(np.array([len(x) for x in found])) for found in own]
        flat = [zstandard.compress(np.array([i for x in found for i in x], width).tobytes(), LEVEL) for found in own]
        return pa.table(
            {
                "block": group.column("block"),
                "bucket": group.column("bucket"),
                "counts": pa.array(counts, pa.binary()),
                "ids": pa.array(flat, pa.binary()),
            }
        )

    table = blocks.filter("bucket IS NOT NULL").select("block", "bucket", "chunks").groupBy("bucket")
    ids = table.applyInArrow(segmented, _IDS)
    out = typed("ids array<int>, decoded string", row=row_type)

    def joined(block: pa.Table, found: pa.Table) -> pa.Table:
        """The rows of a block, with ids by the numbers of their chunks."""
        found = found.sort_by("bucket")
        none = np.empty(0, np.int64)
        counts = np.concatenate([none, *map(_unpacked, found.column("counts").to_pylist())])
        flat = b"".join(map(zstandard.decompress, found.column("ids").to_pylist()))
        flat = np.frombuffer(flat, width).astype(np.int32)
        first = np.cumsum(counts) - counts
        model, out = worker_model(shared.value), []
        for rows, lengths, codes, top in zip(*(block.column(n) for n in ("rows", "lengths", "codes", "top"))):
            codes, top = _unpacked(codes.as_py()), _unpacked(top.as_py())
            at = np.where(codes < len(top), np.append(top, 0)[np.minimum(codes, len(top))], codes - len(top))
            end, begin, ids, decoded = 0, 0, [], []
            ends = np.cumsum(_unpacked(lengths.as_py())).tolist()
            for k, last in enumerate(ends):
                own, end = at[end:last], last
                many = counts[own]
                places = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                ids.append(flat[places])
                decoded.append(model.decode(ids[-1].tolist()))
                if k + 1 - begin == AT_ONCE or k + 1 == len(ends):
                    out.append(_texts(ids, decoded, rows.values.slice(begin, len(ids))))
                    begin, ids, decoded = k + 1, [], []
        return pa.Table.from_batches(out, pa.schema([("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("row", arrow_row)]))

    own = blocks.filter("bucket IS NULL").select("block", "rows", "lengths", "codes", "top")
    return own.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(joined, out)
