"""A training corpus out of raw documents: the stages, and all of them in order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import keyed, ordered_id, restored, table, written
from parley.llm.decontamination import decontaminated
from parley.llm.jaccard import similar_documents
from parley.llm.langid import held_out, identify
from parley.llm.lines import dedup_lines
from parley.llm.packing import pack_documents
from parley.session import bounded_batches

#: Near duplicates: runs of five words, and hundredths of the union in common.
WORDS, PERCENT = 5, 80
VOCABULARY = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go; lang becomes the predicted language."""
    bounded_batches(spark)
    found = identify(docs, docs.filter(~held_out())).filter("accepted")
    return restored(found, docs, text=F.col("text"), lang=F.col("lang_pred"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but where the smallest id has them. Documents stay, also those that have no line left."""
    bounded_batches(spark)
    return restored(dedup_lines(docs), docs, text=F.col("text"), n_chars=F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest id stays; of equal rows of one id, one."""
    bounded_batches(spark)
    found = similar_documents(docs.select("doc_id", "text"), PERCENT, WORDS)
    stays = found.filter("is_first").select(ordered_id(), "text_hash").distinct()
    joined = keyed(docs).join(stays, ["doc", "text_hash"], "left_semi")
    copy = F.row_number().over(Window.partitionBy("doc", "text_hash").orderBy("doc"))
    return restored(joined.withColumn("copy", copy).filter("copy = 1"), docs, text=F.col("text"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    bounded_batches(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of all documents with their ids, sequence and place."""
    bounded_batches(spark)
    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression, word pieces and bin packing are no SQL.
ORACLE_SQL = None
