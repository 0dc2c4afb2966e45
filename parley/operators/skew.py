"""Uneven work: joins with an aggregate when the other side has a hot key, and rows of few files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def splittable(*keys: str | Column) -> Column:
    """A further grouping key that follows from ``keys``, so that it changes no group.

    Grouped by the keys alone, a frame is already partitioned the way a join on them
    needs it. The join then reads the aggregate directly, and adaptive execution, which
    splits hot partitions only where a join reads two shuffles, leaves a hot key of the
    other side in one task. With this key the grouped frame, one row per group, is
    shuffled for the join and the hot key can be split.
    """
    return F.xxhash64(*keys).alias("_follows")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to three tasks for each core; a task holds none of them together.

    Files are dealt to tasks by bytes, and a part of a file no smaller than a row group: a
    million short rows may be one task, however much has to be made of each.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)
