"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import written

__all__ = [
    "ID", "LAST_ID", "LOWER", "SPACE", "by_size", "doc_id", "keyed", "lean", "mixed", "ordered_id", "rest_of_row", "restored", "signed",
    "sliced", "table", "texts_of", "typed", "written",
]

#: Ids where they are compared: a null id is 2^63, which no long is, and so sorts after all others.
ID = "decimal(20,0)"
LAST_ID = 1 << 63
#: ASCII white space and A-Z, as bytes.
SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rest_of_row(df: DataFrame, text_col: str) -> Column:
    """The columns of ``df`` besides the text as one struct, so that none can clash with an operator's own."""
    return F.struct(*[df[f"`{name}`"] for name in df.columns if name != text_col]).alias("row")


def restored(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``like`` out of the struct ``row``; some of them, the text at least, given anew."""
    return df.select(*[changed[n].alias(n) if n in changed else F.col(f"row.`{n}`") for n in like.columns])


def typed(columns: str, **more: T.DataType) -> T.StructType:
    """A schema from DDL and further columns of given types."""
    schema = T.StructType.fromDDL(columns) if columns else T.StructType()
    for name, kind in more.items():
        schema = schema.add(name, kind)
    return schema


def ordered_id(id_col: str = "doc_id") -> Column:
    """An id that is never null and sorts as ids do, a null one last."""
    return F.coalesce(F.col(id_col).cast("long").cast(ID), F.lit(str(LAST_ID)).cast(ID)).alias("doc")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (the id, null as the last), text_hash (tells apart rows of one id), text, row (all other columns)."""
    return docs.select(
        ordered_id(id_col),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).alias("text"),
        rest_of_row(docs, text_col),
    )


def doc_id(doc: str = "doc") -> Column:
    """The id that ``keyed`` replaced; 2^63 is no long, so it is null again."""
    return F.col(doc).try_cast("long").alias("doc_id")


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds less at once."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def by_size(batches: Iterator[pa.RecordBatch], column: str, n_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes in ``column``, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes.astype(np.int64) + 64), 0  # a row is never nothing
        while begin < batch.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + n_bytes, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def lean() -> None:
    """Gives back what earlier tasks of this worker process remember or have left unused.

    Workers outlive their tasks, and so do encoders that are kept for tasks to come.
    """
    if kept := sys.modules.get("_parley_worker"):
        kept.__dict__.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text of an Arrow column."""
    return column.cast(pa.large_binary()).to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return x.view(np.int64)
