"""Datasets: read raw ones, write and read prepared ones."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.names import formatted_path

# Endings of the files of each format.
FORMATS = {
    "json": "*.{json,jsonl,ndjson,json.gz,jsonl.gz,ndjson.gz}",
    "csv": "*.{csv,csv.gz}",
    "parquet": "*.parquet",
}
# The splits that are looked for, in order, and how files of a split are kept.
SPLITS = ("train", "test")
LAYOUTS = ("{path}/{split}", "{path}/{split}[-_.]*", "{path}/data/{split}[-_.]*")


class UnreadFiles(ValueError):
    """A folder has files, but none of the format that was asked for."""


def read_dataset(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
    schema=None,
    split: str | None = None,
    row_id: str | None = None,
) -> DataFrame | None:
    """One split of a dataset; None when it cannot be read.

    A split is a sub-folder of its name, or files whose names begin with it. Without
    ``split`` the first of train and test is read; a dataset kept without splits is read
    whole. A named split that is not there is None.

    Give ``schema`` for JSON and CSV of any size: without it Spark reads the files
    once more to infer one. CSV files are split between tasks; texts with line breaks
    inside quotes need the option ``multiLine``, and one JSON array over many lines too.

    ``row_id`` names a column for the position of a row, if there is none of that name
    (``positions``).
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}, expected one of {tuple(FORMATS)}")

    def load(where: str, endings: str = FORMATS[fmt]) -> DataFrame | None:
        reader = spark.read.format(fmt).option("pathGlobFilter", endings)
        if fmt == "csv":
            reader = reader.options(header="true", escape='"')
        if schema is not None:
            reader = reader.schema(schema)
        try:
            found = reader.options(**(options or {})).load(where)
        except AnalysisException:
            return None
        if row_id is None or row_id in found.columns:
            return found
        return found.withColumn(row_id, positions(fmt))

    base = path.rstrip("/")
    for name in [split] if split else SPLITS:
        for layout in LAYOUTS:
            where = layout.format(path=base, split=name)
            found = load(where)
            if found is not None and _has_files(spark, where, FORMATS[fmt]):
                return found
    if split:
        return None
    if _has_files(spark, base, FORMATS[fmt]):
        return load(base)
    if _has_files(spark, base, "*"):
        raise UnreadFiles(f"{path} has no {fmt} files ({FORMATS[fmt]})")
    return None


def _has_files(spark: SparkSession, where: str, endings: str) -> bool:
    """Whether there is a file of these endings; only names are read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", endings)
    try:
        return not reader.option("recursiveFileLookup", "true").load(where).select("path").isEmpty()
    except AnalysisException:
        return False


def positions(fmt: str) -> Column:
    """The position of a row of files that are being read: its file, and its number there.

    Parquet files number their rows. Rows of other formats have the begin of the part of
    the file that a task reads, and their number in that task; both follow from the files
    and the session's settings, so the same read gives the same ids. No row moves for it.
    Use it on a frame that comes straight from the reader.
    """
    file = F.md5(F.col("_metadata.file_path"))
    if fmt == "parquet":
        return F.concat_ws("-", file, F.col("_metadata.row_index"))
    # the lower bits are the number of a row in its task
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.concat_ws("-", file, F.col("_metadata.file_block_start"), number)


def with_row_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """``df`` with an id for every row, the same each time, whatever task reads it.

    Rows of Parquet files get their position (``positions``), and nothing is shuffled.
    Other rows get an id made of what they hold and the number of the copy, which shuffles
    hashes and rows; copies are alike, so it does not matter which is which. Give
    ``read_dataset`` a ``row_id`` to spare that for other formats.
    """
    try:
        return df.withColumn(name, positions("parquet"))
    except AnalysisException:  # no rows of Parquet files
        pass
    content = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256).alias("_content")
    marked = df.select("*", content)
    copy = F.row_number().over(Window.partitionBy("_content").orderBy("_content"))
    return marked.withColumn(name, F.concat_ws("-", "_content", copy)).drop("_content")


# Where readers put what they cannot parse.
_UNREAD = "_unread"


def read_with_rejects(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | str, options: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of JSON or CSV files that can be parsed, and the others: file, line, reason.

    A row that is no JSON document, or whose values do not fit ``schema``, costs itself
    only and stays with its text; the reason says how many of its values could be read.
    Files of other endings are named too, each once, without a line.
    """
    if fmt not in ("json", "csv"):
        raise ValueError(f"rows of {fmt} files cannot be set apart, only of json and csv")
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if _UNREAD in fields.names:
        raise ValueError(f"the schema may not have a column {_UNREAD}")
    whole = T.StructType([*fields.fields, T.StructField(_UNREAD, T.StringType())])
    reader = spark.read.format(fmt).schema(whole).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", _UNREAD).option("pathGlobFilter", FORMATS[fmt])
    if fmt == "csv":
        reader = reader.options(header="true", escape='"')
    rows = reader.option("recursiveFileLookup", "true").options(**(options or {})).load(path)
    names = [F.col(f"`{n}`") for n in fields.names]
    # Counting the values makes the reader parse all columns, whichever are wanted later:
    # a value of the wrong type in any of them tells a row from the good ones.
    values = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in names), F.lit(0))
    told = rows.select(*names, _UNREAD, F.col("_metadata.file_path").alias("_file"), values.alias("_values"))
    told = told.where("_values >= 0")
    rejects = told.where(F.col(_UNREAD).isNotNull()).select(
        F.col("_file").alias("file"),
        F.col(_UNREAD).alias("line"),
        F.concat(F.lit("unparsed, values: "), F.col("_values").cast("string")).alias("reason"),
    )
    others = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    endings = "|".join(re.escape(e) for e in _endings(fmt))
    others = others.where(~F.col("path").rlike(f"({endings})$")).select(
        F.col("path").alias("file"), F.lit(None).cast("string").alias("line"), F.lit("other format").alias("reason")
    )
    return told.where(F.col(_UNREAD).isNull()).select(*names), rejects.unionByName(others)


def _endings(fmt: str) -> list[str]:
    return ["." + e for e in FORMATS[fmt].removeprefix("*.").strip("{}").split(",")]


def _root_of(root: str, model: str | None) -> str:
    """Datasets of a model are kept in a folder of its own, which no other name gives."""
    return root if model is None else f"{root.rstrip('/')}/{quote(model, safe='')}"


def output_path(root: str, name: str, union: bool = False, model: str | None = None) -> str:
    """Where a prepared dataset is kept."""
    return formatted_path(_root_of(root, model), name, union)


@dataclass(frozen=True)
class Staged:
    """Rows that are written and not yet published."""

    folder: str
    path: str


def stage_formatted(
    df: DataFrame, root: str, name: str, union: bool = False, model: str | None = None
) -> Staged:
    """Write a prepared dataset beside its place, where no reader looks."""
    path = output_path(root, name, union, model)
    staged = Staged(f"{_folder_of(path)}/_staging-{uuid.uuid4().hex}", path)
    try:
        df.write.option("maxRecordsPerFile", fixed.FILE_ROWS).parquet(staged.folder)
    except Exception:
        remove(df.sparkSession, staged.folder)
        raise
    return staged


def publish(spark: SparkSession, *staged: Staged) -> None:
    """Put staged rows in their places by renaming.

    What was there before is kept until the new rows are in place. Should the session end
    between the two renames, ``read_formatted`` still reads it from ``previous_path``.
    """
    for each in staged:
        before = previous_path(each.path)
        if is_there(spark, each.path):
            remove(spark, before)
            _rename(spark, each.path, before)
        try:
            _rename(spark, each.folder, each.path)
        except OSError:
            if is_there(spark, before):
                _rename(spark, before, each.path)
            raise
        remove(spark, before)


def withdraw(spark: SparkSession, *staged: Staged) -> None:
    """Remove staged rows; published ones stay."""
    for each in staged:
        remove(spark, each.folder)


def write_formatted(
    df: DataFrame, root: str, name: str, union: bool = False, model: str | None = None
) -> str:
    """Write a prepared dataset under the name rule and return its path.

    It replaces an earlier one only when all of it is written.
    """
    staged = stage_formatted(df, root, name, union, model)
    publish(df.sparkSession, staged)
    return staged.path


def read_formatted(
    spark: SparkSession, root: str, name: str, union: bool = False, model: str | None = None
) -> DataFrame:
    """The prepared dataset of that name, or its union output."""
    path = output_path(root, name, union, model)
    before = previous_path(path)
    return spark.read.parquet(before if not is_there(spark, path) and is_there(spark, before) else path)


def _folder_of(path: str) -> str:
    return path.rsplit("/", 1)[0]


def previous_path(path: str) -> str:
    """Where the rows of ``path`` are while new ones take their place."""
    return f"{_folder_of(path)}/_previous-{path.rsplit('/', 1)[1]}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _rename(spark: SparkSession, old: str, new: str) -> None:
    files, where = _file_system(spark, old)
    if not files.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} cannot be renamed to {new}")


def is_there(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of rows, if it is there."""
    files, where = _file_system(spark, path)
    files.delete(where, True)
