"""The preparation flow: a card of models and datasets to written training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import route_task
from ..operators.catalog import record_configs, resolve_config
from ..operators.conversations import to_conversations
from ..operators.layout import UnsupportedLayout, detect_layout
from ..operators.skew import spread
from ..operators.tokenizers import CodePointTokenizer
from ..operators.training import EmptyDataset, Measured, measured, padded_rows, token_rows, united
from ..operators.union import TypeClash, column_set
from ..sources.datasets import (
    UnreadFiles,
    is_there,
    output_path,
    publish,
    read_dataset,
    stage_formatted,
    with_row_ids,
    withdraw,
)

_REPORT = "model string, dataset string, status string, columns array<string>, path string, n_rows long"
# What a dataset may fail by. Failures of a job are among them, so that one broken file
# costs one dataset; errors of this package are not.
_SKIPPED = (
    PySparkException, Py4JJavaError, UnsupportedLayout, EmptyDataset, TypeClash, UnreadFiles, OSError,
)

Source = Callable[[str, str | None], DataFrame | None]


def directory_source(
    spark: SparkSession,
    root: str,
    fmt: str = "parquet",
    split: str | None = None,
    details: dict[str, dict] | None = None,
    row_id: str | None = None,
) -> Source:
    """Datasets kept as ``root/<last part of the name>[/<config>]``.

    ``details`` gives some datasets arguments of their own for ``read_dataset``: fmt,
    options, schema, split or row_id.
    """

    def load(name: str, config: str | None) -> DataFrame | None:
        path = f"{root.rstrip('/')}/{name.rsplit('/', 1)[-1]}"
        own = {"fmt": fmt, "split": split, "row_id": row_id} | (details or {}).get(name, {})
        return read_dataset(spark, f"{path}/{config}" if config else path, **own)

    return load


def chosen_configs(
    spark: SparkSession, catalog: DataFrame | None, saved: DataFrame | None
) -> DataFrame:
    """(dataset, config): the saved choice, else the first one listed in ``catalog``."""
    if saved is None:
        saved = spark.createDataFrame([], "dataset string, config string")
    if catalog is None:
        return saved.select("dataset", "config")
    return record_configs(saved, resolve_config(catalog, saved))


def _entries(card: DataFrame, configs: DataFrame) -> Iterator:
    """Card rows in order, with the config of each dataset.

    Only names reach the driver, a part at a time, because each dataset has its own
    schema and so its own job.
    """
    entries = card.where(F.col("dataset").isNotNull()).join(configs, "dataset", "left")
    position = "position" if "position" in entries.columns else "dataset"
    rows = entries.orderBy("model", position).select("model", "dataset", "config")
    return rows.toLocalIterator()


def prepare_all(
    spark: SparkSession,
    card: DataFrame,
    root: str,
    source: Source,
    id_cols: str | list[str] = "id",
    saved: DataFrame | None = None,
    tokenizer_for: Callable[[str], object] | None = None,
    pad: str = "max",
    listing_for: Callable[[str], DataFrame | None] | None = None,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Prepare and write every dataset of the card; returns the training manifest.

    Per model the first usable dataset is written alone; each later one is written
    alone and once more together with the first, under the union name. Every dataset is
    read, rendered and tokenised once; the number of rows, the longest and whether a label
    counts are observed on the way. Where all rows get the length of the longest, token rows
    are kept without padding first. Otherwise a row has its length from itself: it is padded
    and written at once, and the union is made of padded rows. Its
    rows are dealt evenly to tasks first (``spread``), and files have ``FILE_ROWS`` at most.
    A dataset that cannot be read, recognised, computed or trained on is skipped, and the
    rest goes on. Its outputs are published together once all of them are written, so what
    an earlier run has published stays readable until then, and for good if this run fails.
    The config of a dataset is the saved one, else the first of ``catalog``
    (``chosen_configs``, to be kept with ``write_configs``). A dataset without the id
    columns gets an id (``with_row_ids``), as the first of them.
    Every model has a folder of its own. Two names of one model that give one folder are
    not both written: the second is reported as PathTaken.
    The manifest (model, dataset, status, columns, path, n_rows) records the columns of
    the first and the current dataset together, where the rows of the dataset are (also
    those of an earlier run, if this one has failed), and how many this run has published.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    keys = ["dataset", *ids]
    report = []
    first: Measured | None = None
    first_columns: list[str] = []
    current_model = None
    taken: set[str] = set()

    for model, name, config in _entries(card, chosen_configs(spark, catalog, saved)):
        if model != current_model:
            first, first_columns, current_model, taken = None, [], model, set()
        tokenizer = tokenizer_for(model) if tokenizer_for else CodePointTokenizer()
        listing = listing_for(name) if listing_for else None

        paths = [output_path(root, name, union, model) for union in (False, True)]

        def failed(status: str, own: bool = True) -> tuple:
            there = own and is_there(spark, paths[0])
            return model, name, status, None, paths[0] if there else None, None

        if taken.intersection(paths):
            report.append(failed("PathTaken", own=False))
            continue
        staged = []
        try:
            raw = source(name, config)
            if raw is None:
                report.append(failed("unreadable"))
                continue
            missing = [c for c in ids if c not in raw.columns]
            for column in missing[:1]:
                raw = with_row_ids(raw, column)
            for column in missing[1:]:
                raw = raw.withColumn(column, F.lit(None).cast("string"))
            conversations = to_conversations(raw, ids)
            columns = sorted({*column_set(conversations.drop(*ids)), *first_columns})
            named = conversations.withColumn("dataset", F.lit(name))
            media = tuple(detect_layout(named.schema, tuple(keys)).media)
            rows = token_rows(spread(named), keys, tokenizer, check=False, listing=listing)

            def stage(rows: DataFrame, union: bool = False) -> DataFrame:
                staged.append(stage_formatted(rows, root, name, union=union, model=model))
                return spark.read.schema(rows.schema).parquet(staged[-1].folder)

            own = measured(rows, media, None if pad == "max" else lambda df: stage(padded_rows(df, tokenizer, pad)))
            if not own.n_rows or not (media or own.any_label):
                raise EmptyDataset("no row, or no label, of the dataset counts")
            if pad == "max":
                stage(padded_rows(own.rows, tokenizer, pad, own.longest))
            if first is not None:
                both = united(first, own)
                if pad == "max":
                    both = padded_rows(both, tokenizer, pad, max(first.longest, own.longest))
                stage(both, union=True)
            publish(spark, *staged)
            if first is None:
                first, first_columns = own, column_set(conversations.drop(*ids))
                if pad != "max":  # they are in their place now
                    first = replace(own, rows=spark.read.schema(own.rows.schema).parquet(paths[0]))
            taken.update(paths)
            report.append((model, name, "prepared", columns, paths[0], own.n_rows))
        except _SKIPPED as reason:
            withdraw(spark, *staged)
            report.append(failed(type(reason).__name__))
    return spark.createDataFrame(report, _REPORT)


def training_card(manifest: DataFrame) -> DataFrame:
    """The manifest as a card (model, dataset, info), to be kept with ``write_manifest``.

    ``info`` lists the columns as JSON. A model without a prepared dataset is an empty
    entry.
    """
    prepared = manifest.where(F.col("status") == "prepared")
    entries = prepared.select("model", "dataset", F.to_json("columns").alias("info"))
    models = manifest.select("model").distinct().join(prepared, "model", "left_anti")
    return entries.unionByName(models, allowMissingColumns=True)


def training_inputs(spark: SparkSession, card: DataFrame, root: str) -> DataFrame:
    """(model, dataset, task, train_rows) of the prepared datasets of a training card.

    One scan counts the rows of the card's own datasets by file; it reads no column.
    """
    prepared = card.where(F.col("dataset").isNotNull()).select(
        "model",
        "dataset",
        route_task(F.from_json("info", "array<string>")).alias("task"),
    )
    # One path for each dataset of the card; each was written by a job of its own.
    paths = [
        (model, name, output_path(root, name, model=model))
        for model, name in prepared.select("model", "dataset").distinct().toLocalIterator()
    ]
    there = [path for *_, path in paths if is_there(spark, path)]
    if not there:
        return prepared.withColumn("train_rows", F.lit(0).cast("long"))
    folders = spark.createDataFrame(paths, "model string, dataset string, path string")
    # Spark reports file paths as URIs, where a plus sign stands for itself.
    file = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    folder = F.array_join(F.slice(F.split(file, "/"), -3, 2), "/")
    counts = (
        spark.read.parquet(*there)
        .groupBy(folder.alias("_folder"))
        .agg(F.count(F.lit(1)).alias("train_rows"))
    )
    own = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    counted = folders.withColumn("_folder", own).join(counts, "_folder", "left")
    return prepared.join(counted.select("model", "dataset", "train_rows"), ["model", "dataset"], "left")
