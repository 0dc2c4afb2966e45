"""Manifests: the card of models and datasets, and saved configurations, as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CARD = "model map<string, map<string, string>>"
_EMPTY_CARD = "model string, dataset string, info string"
_EMPTY_CONFIGS = "dataset string, config string"
_UNPARSED = "file string, value string"


def parse_card(documents: DataFrame, col: str = "value") -> DataFrame:
    """(model, dataset, info) rows of JSON cards; an empty entry has a null dataset."""
    card = documents.select(F.from_json(col, _CARD).alias("card"))
    models = card.select(F.explode("card.model").alias("model", "datasets"))
    return models.select("model", F.explode_outer("datasets").alias("dataset", "info"))


def card_documents(card: DataFrame) -> DataFrame:
    """One small JSON card per entry, in ``value``. Together they are the whole card."""
    none = F.create_map().cast("map<string, string>")
    info = F.coalesce("info", F.lit(""))
    datasets = F.when(F.col("dataset").isNotNull(), F.create_map("dataset", info)).otherwise(none)
    document = F.struct(F.create_map(F.col("model"), datasets).alias("model"))
    return card.select(F.to_json(document).alias("value"))


def single_document(card: DataFrame) -> DataFrame:
    """The card as one JSON document, for readers that expect one.

    One document is one row, which one task makes; a card of any size is written as
    lines.
    """
    entry = F.when(
        F.col("dataset").isNotNull(),
        F.struct("dataset", F.coalesce("info", F.lit("")).alias("info")),
    )
    datasets = F.map_from_entries(F.array_sort(F.collect_set(entry)))
    models = card.groupBy("model").agg(datasets.alias("datasets"))
    model = F.map_from_entries(F.collect_list(F.struct("model", "datasets")))
    return models.agg(F.to_json(F.struct(model.alias("model"))).alias("value"))


def _documents(spark: SparkSession, path: str, parsed: Column) -> DataFrame | None:
    """(file, value, good): the JSON documents in ``path``; None when there is nothing.

    A file with a line that is a document is read by lines, any other file as one document,
    which a single task holds. ``parsed`` is null where ``value`` is no document.
    """
    try:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
        lines = lines.where(F.trim("value") != "").withColumn("good", parsed.isNotNull())
        whole = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("file"), "value"
        )
    except AnalysisException:
        return None
    by_line = lines.groupBy("file").agg(F.bool_or("good").alias("by_line"))
    files = by_line.where("by_line").select("file")
    others = by_line.where("NOT by_line").select("file")
    single = whole.join(others, "file", "left_semi").withColumn("good", parsed.isNotNull())
    return lines.join(files, "file", "left_semi").unionByName(single)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The card in ``path``; empty when there is none.

    Documents may stand one per line or fill a file, indented or not, in any number of
    files. What is no card is left out here and listed by ``unparsed_manifest``.
    """
    documents = _documents(spark, path, F.from_json("value", _CARD)["model"])
    if documents is None:
        return spark.createDataFrame([], _EMPTY_CARD)
    return parse_card(documents.where("good"))


def unparsed_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the documents in ``path`` that are no card."""
    documents = _documents(spark, path, F.from_json("value", _CARD)["model"])
    if documents is None:
        return spark.createDataFrame([], _UNPARSED)
    return documents.where("NOT good").select("file", "value")


def write_manifest(card: DataFrame, path: str, lines: bool = True) -> None:
    """Write the card, one small document per entry and line, or as one document."""
    documents = card_documents(card) if lines else single_document(card)
    documents.write.mode("overwrite").text(path)


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, config) of saved choices, in the same forms as a card; empty when there are none."""
    saved = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    documents = _documents(spark, path, saved)
    if documents is None:
        return spark.createDataFrame([], _EMPTY_CONFIGS)
    return documents.where("good").select(F.explode(saved).alias("dataset", "config"))


def unparsed_configs(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the documents in ``path`` that hold no choices."""
    documents = _documents(spark, path, F.from_json("value", T.MapType(T.StringType(), T.StringType())))
    if documents is None:
        return spark.createDataFrame([], _UNPARSED)
    return documents.where("NOT good").select("file", "value")


def write_configs(saved: DataFrame, path: str) -> None:
    """Write saved choices, one document per dataset and line."""
    pair = F.create_map(F.col("dataset"), F.col("config"))
    document = F.to_json(pair, {"ignoreNullFields": "false"})
    saved.select(document.alias("value")).write.mode("overwrite").text(path)
