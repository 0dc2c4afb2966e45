"""Language identification by compression.

Every language has a raw-content dictionary: text of a bounded sample of its labelled documents. The whole text is
compressed with each dictionary, and the language whose dictionary leaves the fewest bytes is chosen. The score is how
much more the second best needs, as a share; a narrow margin rejects the text. A dictionary helps only near the start of
what is compressed, so a text is taken in pieces of ``PIECE`` bytes, each compressed from the dictionary alone, and their
sizes are summed: the margin does not depend on how long a text is.

The dictionaries come from a sample whose bounds are parameters: at most ``SAMPLE_DOCS`` documents a language, drawn by a
hash of id and text, with a piece of at most ``SAMPLE_CHARS`` characters of each, at a place that the hash names too, so
that no part of a text is left out as such. There are at most ``LANGUAGES`` labels (more are refused), so all dictionaries
together have at most ``LANGUAGES * DICTIONARY`` bytes. Counts of labels cover all labelled rows.

A null text, or one without a letter, is undetermined (``und``, score 0, rejected). Equal sizes go to the language with
more labelled documents, then to the smaller name. Without any labelled text everything is undetermined. A null id
counts as not held out. Repeated rows are judged each; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import lean, rest_of_row, sliced, typed

#: The bounds of the sample, and of a dictionary in bytes.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 1500
DICTIONARY = 1 << 16
LANGUAGES = 1 << 10
#: zstandard's level; it decides how well matches in the dictionary are found.
LEVEL = 6
#: Bytes of a text that are compressed together.
PIECE = 1 << 14
#: Texts whose second best language needs less than so large a share more are rejected.
MARGIN = 0.004
UNDETERMINED = "und"
#: Documents that a task holds at once.
AT_ONCE = 500

_LETTER = regex.compile(r"\p{L}")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> list:
    """(language, dictionary) of the languages in ``labelled``, the most frequent first."""
    scale = 1 << 30
    usable = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(label_col).cast("string").alias("label"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)).alias("drawn"),
    )
    counted = usable.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("drawn").alias("different"))
    counts = counted.limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    if not counts:
        return []
    # twice as many as are wanted pass a threshold, so that a task sends on few rows whatever their label is
    shares = labelled.sparkSession.createDataFrame(
        [(r.label, int(scale * min(1.0, 2 * SAMPLE_DOCS / r.different))) for r in counts], "label string, below long"
    )
    place = F.pmod(F.xxhash64(F.lit("place"), "drawn"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1)))
    snippets = (
        usable.join(F.broadcast(shares), "label")  # LANGUAGES rows at most
        .filter(F.pmod("drawn", F.lit(scale)) < F.col("below"))
        .select("label", "drawn", F.substring("text", place.cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("snippet"))
        .distinct()
    )
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("drawn", F.lit(scale)), "drawn", "snippet"))
    sample = snippets.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_DOCS).orderBy("label", "rank")
    content: dict[str, bytearray] = {}
    for row in sample.toLocalIterator():
        own = content.setdefault(row.label, bytearray())
        if len(own) < DICTIONARY:
            own += row.snippet.lower().encode("utf-8", "replace") + b"\n"
    n_docs = {r.label: r.n for r in counts}
    order = sorted(content, key=lambda name: (-n_docs[name], name))
    return [(name, bytes(content[name][:DICTIONARY])) for name in order]


class Classifier:
    def __init__(self, languages: list[tuple[str, bytes]]) -> None:
        self.names = [name for name, _ in languages]
        self.compressors = []
        for _, content in languages:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def judge(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        data = text.lower().encode("utf-8", "replace")
        pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
        sizes = [sum(len(c.compress(piece)) for piece in pieces) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.names[best], (second - sizes[best]) / second


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    margin: float = MARGIN,
) -> DataFrame:
    """doc_id, text, lang_pred, score, accepted, row (the other columns of the input)."""
    learned = docs.sparkSession.sparkContext.broadcast(dictionaries(labelled, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), rest_of_row(docs, text_col))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        classifier = Classifier(learned.value)
        for batch in sliced(batches, AT_ONCE):
            found = [classifier.judge(text) for text in batch.column("text").to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "text": batch.column("text"),
                    "lang_pred": pa.array([name for name, _ in found], pa.string()),
                    "score": pa.array([score for _, score in found], pa.float64()),
                    "accepted": pa.array([n != UNDETERMINED and s >= margin for n, s in found], pa.bool_()),
                    "row": batch.column("row"),
                }
            )
        del classifier
        lean()

    schema = typed("text string, lang_pred string, score double, accepted boolean", row=rows.schema["row"].dataType)
    schema = typed("", doc_id=rows.schema["doc_id"].dataType, **{f.name: f.dataType for f in schema.fields})
    return rows.mapInArrow(judged, schema)
