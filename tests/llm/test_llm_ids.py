"""The largest id is not a null id: both keep their own rows in every operator that compares ids."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm.jaccard import similar_documents
from parley.llm.lines import dedup_lines
from parley.llm.packing import least_bins, pack, pack_documents
from parley.llm.substrings import dedup_substrings

LARGEST = (1 << 63) - 1
LINE = "a line that two documents share"


@pytest.fixture
def docs(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(LARGEST, LINE + "\n" + words), (None, LINE + "\n" + words), (-LARGEST - 1, "alone"), (None, "of its own, too")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_lines(docs):
    found = {(r.doc_id, r.n_lines): r.n_dropped for r in dedup_lines(docs).collect()}
    assert found == {(LARGEST, 2): 0, (None, 2): 2, (-LARGEST - 1, 1): 0, (None, 1): 0}


def test_substrings(docs):
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in dedup_substrings(docs).collect())
    assert [f[0] for f in found] == [False, False, True, True] and found[1][1] == LARGEST
    assert [f[2] for f in found] == [0, 46, 0, 46]


def test_similar_documents(docs):
    found = similar_documents(docs, 90, 3).select("doc_id", "component_id", "is_first").collect()
    by_size = sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0, r.is_first) for r in found)
    assert by_size == [(False, -LARGEST - 1, -LARGEST - 1, True), (False, LARGEST, LARGEST, True), (True, 0, 0, True), (True, 0, LARGEST, False)]


def test_near_duplicates_stage(spark, docs):
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, -LARGEST - 1), (False, LARGEST), (True, 0)]


def test_packing(docs):
    found = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(r.doc_id or 0 for r in found.collect()) == [-LARGEST - 1, 0, 0, LARGEST]


def test_equal_rows_are_dealt_to_many_groups(spark):
    docs = spark.createDataFrame([(None, None)] * 900, "doc_id long, text string").repartition(3)
    found = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), group_chars=50)
    groups = found.groupBy(F.shiftright("sequence_id", 32).alias("part")).count().collect()
    assert sum(r["count"] for r in groups) == 900 and len(groups) > 10 and max(r["count"] for r in groups) < 200


def test_few_bins_against_all_packings():
    import random

    import numpy as np

    def fewest(lengths, size):
        best = [len(lengths)]

        def put(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(lengths):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= size and bins[k] not in bins[:k]:
                    put(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
            put(i + 1, [*bins, lengths[i]])

        put(0, [])
        return best[0]

    rng, more = random.Random(1), 0
    for _ in range(200):
        size = rng.randint(5, 30)
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(1, 9))), reverse=True)
        least, got = fewest(lengths, size), pack(np.array(lengths), size)
        assert sorted(i for b in got for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= size for b in got)
        assert least_bins(lengths, size) <= least <= len(got) <= least + 1
        more += len(got) - least
    assert more <= 4


def test_nothing_to_win_ends_at_once():
    import random
    import time

    import numpy as np

    rng, start = random.Random(2), time.perf_counter()
    bins = pack(np.array([rng.randint(683, 1023) for _ in range(6000)]), 2048)
    assert len(bins) == 3000 and time.perf_counter() - start < 3
