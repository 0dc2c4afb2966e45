"""The queries against their SQL, and the pipeline stage by stage against plain Python."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from check import TABLES, table_of  # noqa: E402
from parley.llm.common import written  # noqa: E402
from parley.llm.registered import ORACLES, QUERIES  # noqa: E402
from test_llm_jaccard import brute as linked  # noqa: E402
from test_llm_lines import brute as deduplicated  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table_of(got) == table_of(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(None, None, None, "s", 0), (-1, "", "en", "s", 0), (-2, docs.first().text, "en", None, None), (-2, docs.first().text, "en", None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, SF))
        assert now.columns == docs.columns
        kept[name] = [(r.doc_id, r.text) for r in now.collect()]
    assert {None, -1}.isdisjoint({i for i, _ in kept["language_id"]})
    assert len(kept["language_id"]) > 0.9 * docs.count()
    assert sorted(kept["line_dedup"]) == sorted((d, t) for d, _, _, t in deduplicated(kept["language_id"]))
    groups = linked(kept["line_dedup"], corpus_pipeline.PERCENT, corpus_pipeline.WORDS)
    assert sorted(i for i, _ in kept["near_duplicates"]) == sorted({i for i, n, c in groups if i == c})
    assert set(kept["decontamination"]) < set(kept["near_duplicates"])
    packed = corpus_pipeline.packing(spark, now, SF).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in kept["decontamination"]}
