"""Preparation of a stream of conversations.

Layout, rendering, tokenising, labels and per-row padding look at one row only, so a
stream needs no state and no watermark. Padding to the longest row and the check
that some label counts need the whole dataset and exist for batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.training import prepare_dataset
from ..sources.datasets import is_folder


def parquet_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a Parquet table as a stream, be the table one file or a folder of them.

    A stream cannot be told one file, only its folder and the name to look for there.
    """
    files = spark.readStream.schema(schema)
    if is_folder(spark, path):
        return files.parquet(path)
    folder, name = path.rsplit("/", 1)
    return files.option("pathGlobFilter", name).parquet(folder)


def training_stream(
    stream: DataFrame, id_cols: str | list[str], tokenizer=None, max_length: int | None = None
) -> DataFrame:
    """Training rows of a streaming frame, each padded to a multiple of its own."""
    return prepare_dataset(stream, id_cols, tokenizer, max_length, pad="multiple", check=False)


def write_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append the rows to Parquet files, exactly once per input row.

    ``available_now`` stops after what is there; otherwise the query keeps running.
    """
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
