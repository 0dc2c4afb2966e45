"""The pair of filters: nothing that occurs twice is missed."""

import numpy as np

from parley.llm.bloom import Pair, contains, seen, seen_twice
from parley.llm.common import mixed


def _own():
    return lambda batch: mixed(batch.column(0).to_numpy().view(np.uint64))  # travels with its task


_hashes = _own()


def test_twice_seen_keys_are_found_over_tasks(spark):
    df = spark.range(0, 3000, 1, 5).selectExpr("id % 2000 AS key")
    words = seen_twice(df, _hashes, word_bits=14).value
    keys = mixed(np.arange(2000, dtype=np.uint64))
    found = contains(words, keys)
    assert found[:1000].all()
    assert found[1000:].mean() < 0.2
    assert contains(seen(df, _hashes, word_bits=14).value, keys).all()


def test_small_filters_only_let_more_through(spark):
    df = spark.range(0, 500, 1, 3).selectExpr("id % 400 AS key")
    assert contains(seen_twice(df, _hashes, word_bits=1).value, mixed(np.arange(100, dtype=np.uint64))).all()


def test_empty_input(spark):
    assert not seen_twice(spark.range(0), _hashes, word_bits=6).value.any()


def test_one_task():
    pair = Pair(10)
    pair.add(mixed(np.array([1, 2, 2, 3], np.uint64)))
    pair.add(mixed(np.array([3, 4], np.uint64)))
    assert contains(pair.twice, mixed(np.array([2, 3], np.uint64))).all()
    assert contains(pair.once, mixed(np.array([1, 2, 3, 4], np.uint64))).all()
