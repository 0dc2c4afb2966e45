from pathlib import Path

from parley.session import clear_written, shared_dir, written


def test_written_tables_are_read_by_column_and_removed(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 100) AS t")
    folder = Path(shared_dir(spark).split(":", 1)[-1])
    before = set(folder.glob("table-*"))
    kept = written(df)
    (path,) = set(folder.glob("table-*")) - before
    assert kept.count() == 10 and kept.dtypes == df.dtypes
    plan = kept.agg({"id": "max"})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    clear_written(spark)
    assert not path.exists()
