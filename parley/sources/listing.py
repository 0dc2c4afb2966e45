"""Media listing of a dataset directory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "place string, path string, name string"


def _zip_reader():
    """A function for ``mapInPandas``: the entries of each archive.

    It reads only the archive's directory, at its end. It is made here, inside another
    function, so that executors get its code with the task and need not have this
    package.
    """
    batch_size = 10_000

    def open_file(path: str):
        from pyarrow import fs

        if path.startswith("file://"):
            return fs.LocalFileSystem().open_input_file(path.removeprefix("file://"))
        # Hadoop's names for the same store.
        for scheme in ("s3a://", "s3n://"):
            path = path.replace(scheme, "s3://", 1) if path.startswith(scheme) else path
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile

        for batch in batches:
            for path in batch["path"]:
                with open_file(path) as file, zipfile.ZipFile(file) as archive:
                    names = archive.namelist()
                for start in range(0, len(names), batch_size):
                    part = names[start : start + batch_size]
                    yield pd.DataFrame(
                        {"place": "zip", "path": [f"{path}/{n}" for n in part], "name": part}
                    )

    return entries


def _uri(path: Column) -> Column:
    # file:/a/b, as Spark writes local paths, is file:///a/b for other readers.
    return F.regexp_replace(path, "^file:/(?!/)", "file:///")


def media_listing(spark: SparkSession, root: str) -> DataFrame:
    """(place, path, name) of top-level files, files in sub-folders and zip entries.

    ``name`` is what a reference may call the file. A file in a sub-folder goes by its
    own name and by the ends of its path inside that folder, one row each: x/a/b.jpg is
    found as b.jpg and as a/b.jpg. File contents are never read: only ``path`` is
    projected. A listing that exists as a table (an inventory of the store) can be used
    in its place.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(_uri(F.col("path")).alias("path"))
    )
    # Paths come back with scheme and host; what follows the root starts after it.
    base = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    inside = F.substr("path", F.locate(base, F.col("path")) + F.lit(len(base)))
    parts = F.col("_parts")
    ends = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, -n, n), "/"),
    )
    listed = files.withColumn("_parts", F.split(inside, "/")).select(
        F.when(F.size(parts) > 1, "folder").otherwise("top").alias("place"),
        "path",
        F.explode(ends).alias("name"),
    )
    archives = listed.where((F.col("place") == "top") & F.col("name").endswith(".zip"))
    entries = archives.select("path").mapInPandas(_zip_reader(), _SCHEMA)
    return listed.unionByName(entries)
