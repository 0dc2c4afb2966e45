"""Token counts by an exact histogram of encoded lengths, and the encoder it shares with packing.

Documents are aggregated by their length in tokens. Everything else comes from that histogram by suffix sums: how many
documents are longer than a context limit, how many tokens are kept if longer ones are cut there, and quantiles. The
sums run over blocks of lengths first and inside each block then, so no step holds more than one block and the list
of blocks.

A null or empty text has no tokens; it counts as a document of length 0. Every row counts, repeated ones too. An empty
table has an empty histogram.
"""

from __future__ import annotations

import string
import sys
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path
from types import ModuleType

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm.common import texts_of, written

#: Runs, and pre-tokens, that a task remembers the ids of; longer ones, in bytes, are encoded each time.
CACHED_WORDS = 350_000
CACHED_BYTES = 64
#: Marks that end a word, and the first letter behind Latin-1.
MARKS = string.punctuation.replace("'", "")
LATIN_END = chr(256)
#: Bytes as characters: those that are printable in Latin-1 are themselves, the others follow behind it in their order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Lengths that are summed together.
BLOCK = 1024


class WordEncoder(dict):
    """Ids of a vocabulary that drops white space, as packed unsigned 32-bit integers.

    Such a vocabulary encodes every run between white space on its own, and every pre-token of a run on its own, so ids
    of both are kept, of the first ones that come; frequent words are among them. Words of Latin letters skip the rest of the tokenizer; texts that hold a special token do not.
    """

    def __init__(self, vocabulary: str) -> None:
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of a run of letters, or of marks, that is normal already."""
        packed = self.pieces.get(piece)
        if packed is None:
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_CHARS)
            packed = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(self.pieces) < CACHED_WORDS and len(piece) <= CACHED_BYTES:
                self.pieces[piece] = packed
        return packed

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "replace")
        packed = None
        if text.isascii() or max(text) < LATIN_END:  # where lower case is by character and nothing composes
            lower = text.lower()
            if lower.isalpha():
                packed = self._piece(lower)
            else:
                body = lower.rstrip(MARKS)
                if body.isalpha():  # letters are one pre-token, what stands behind them another
                    packed = self._piece(body) + self._piece(lower[len(body) :])
        if packed is None:
            packed = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) < CACHED_WORDS and len(run) <= CACHED_BYTES:
            self[run] = packed
        return packed

    def ids(self, text: bytes | None) -> bytes:
        text = text or b""
        runs = text.split()
        if any(token in text for token in self.special):
            return b"".join(
                array("I", self.tokenizer.encode(r.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
                for r in runs
            )
        return b"".join(map(self.__getitem__, runs))


def worker_encoder(vocabulary: str) -> WordEncoder:
    """One encoder for each worker process, so that what it remembers serves all tasks there."""
    kept = sys.modules.setdefault("_parley_worker", ModuleType("_parley_worker")).__dict__
    if kept.get("vocabulary") != vocabulary:
        kept["vocabulary"], kept["encoder"] = vocabulary, WordEncoder(vocabulary)
    return kept["encoder"]


def vocabulary(path: str | Path) -> str:
    """The text of a vocabulary file, read on the driver and sent with the tasks."""
    return Path(path).read_text(encoding="utf-8")


def length_histogram(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """length, n_docs: how many rows have so many tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for batch in batches:
            own = [len(encoder.ids(text)) // 4 for text in texts_of(batch.column(0))]
            yield pa.record_batch({"length": pa.array(own, pa.int64())})

    counted = docs.select(text_col).mapInArrow(lengths, "length long")
    return counted.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit:

    length, n_docs, docs_below (shorter ones), docs_from (this long or longer), tokens_from (theirs), n_longer (cut at
    this limit), tokens_kept (of all documents, if longer ones are cut), tokens_total, docs_total.
    """
    counts = written(histogram).select(  # it is read twice, and its texts must not be
        "length",
        "n_docs",
        (F.col("length") * F.col("n_docs")).alias("n_tokens"),
        F.floor(F.col("length") / BLOCK).alias("block"),
    )
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_blocks = Window.partitionBy()
    blocks = (
        counts.groupBy("block")
        .agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
        .select(
            "block",
            F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_after"),
            F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_after"),
            F.sum("docs").over(all_blocks).alias("docs_total"),
            F.sum("tokens").over(all_blocks).alias("tokens_total"),
        )
    )
    here = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(here) + F.col("docs_after")).alias("docs_from"),
        (F.sum("n_tokens").over(here) + F.col("tokens_after")).alias("tokens_from"),
        "docs_total",
        "tokens_total",
    )
    return sums.select(
        "length",
        "n_docs",
        (F.col("docs_total") - F.col("docs_from")).alias("docs_below"),
        "docs_from",
        "tokens_from",
        (F.col("docs_from") - F.col("n_docs")).alias("n_longer"),
        (F.col("tokens_total") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("tokens_kept"),
        "tokens_total",
        "docs_total",
    )


def truncated_totals(sums: DataFrame, limits: Iterable[int]) -> DataFrame:
    """context_limit, n_longer, tokens_kept, tokens_cut of any limits, out of ``suffix_sums``."""
    rows = []
    for limit in sorted(set(limits)):
        longer = F.col("length") > limit
        rows.append(
            sums.agg(
                F.lit(limit).cast("long").alias("context_limit"),
                F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("n_longer"),
                F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens_kept"),
                F.coalesce(
                    F.sum(F.when(longer, (F.col("length") - limit) * F.col("n_docs"))), F.lit(0)
                ).alias("tokens_cut"),
            )
        )
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def length_quantiles(sums: DataFrame, shares: Iterable[float]) -> DataFrame:
    """share, length: the smallest length that at least so large a share of the documents does not exceed."""
    upto = F.col("docs_below") + F.col("n_docs")
    aggregates = [
        F.min(F.when(upto >= F.ceil(F.lit(float(q)) * F.col("docs_total")), F.col("length"))).alias(f"q{i}")
        for i, q in enumerate(shares)
    ]
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)])
    return sums.agg(*aggregates).select(F.inline(pairs))
