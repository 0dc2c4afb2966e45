"""Catalogue: splits, configurations, files, and the card of models and datasets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .skew import splittable


def select_split(catalog: DataFrame, default: str = "train") -> DataFrame:
    """(dataset, config, split): train if listed, else test, else ``default``."""

    def listed(split: str):
        return F.bool_or(F.col("split") == split)

    return catalog.groupBy("dataset", "config").agg(
        F.when(listed("train"), "train")
        .when(listed("test"), "test")
        .otherwise(default)
        .alias("split")
    )


def resolve_config(catalog: DataFrame, saved: DataFrame) -> DataFrame:
    """(dataset, config): the saved one if recorded, else the first listed."""
    listed = catalog.groupBy("dataset").agg(F.min_by("config", "position").alias("_listed"))
    recorded = saved.select("dataset", F.col("config").alias("_saved"), F.lit(True).alias("_is"))
    return listed.join(recorded, "dataset", "left").select(
        "dataset", F.when(F.col("_is"), F.col("_saved")).otherwise(F.col("_listed")).alias("config")
    )


def record_configs(saved: DataFrame, resolved: DataFrame) -> DataFrame:
    """``saved`` plus the choices for datasets it does not have yet."""
    new = resolved.join(saved, "dataset", "left_anti")
    return saved.select("dataset", "config").unionByName(new.select("dataset", "config"))


def filter_files(
    listing: DataFrame, patterns: Iterable[str] = fixed.DATASET_FILES, col: str = "path"
) -> DataFrame:
    """Files matching one of the patterns (``*`` and ``?``), case-sensitive.

    Written as LIKE, so that ``*.json`` becomes a suffix test the scan can use.
    """
    condition = F.lit(False)
    for pattern in patterns:
        if "[" in pattern:
            raise ValueError(f"character sets are not supported: {pattern}")
        escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        like = escaped.replace("*", "%").replace("?", "_")
        condition = condition | F.col(col).like(like)
    return listing.where(condition)


def upsert_manifest(card: DataFrame, models: DataFrame, datasets: DataFrame) -> DataFrame:
    """The card (model, dataset, info) after listing ``models`` with ``datasets``.

    A listed model's old entry is replaced by all listed datasets; other models keep
    theirs. With no dataset listed, a listed model becomes an empty entry, a row with
    a null dataset.

    Every listed model gets every listed dataset, so the result has models x datasets
    new rows. The names of the datasets are gathered once, as one array, which goes to
    every listed model and is expanded there: they are as many as someone lists in one
    call.
    """
    models = models.select("model", splittable("model")).distinct().select("model")
    names = datasets.select("dataset").where(F.col("dataset").isNotNull())
    listed = names.agg(F.sort_array(F.collect_set("dataset")))
    entries = models.withColumn("_names", listed.scalar()).select(
        "model", F.explode_outer("_names").alias("dataset"), F.lit("").alias("info")
    )
    kept = card.join(models, "model", "left_anti").select("model", "dataset", "info")
    return kept.unionByName(entries)
