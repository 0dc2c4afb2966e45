"""One key holds most rows: the joins split it, and nothing is lost."""

import pytest
from pyspark.sql import functions as F

from parley import operators as op

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_limits(spark):
    old = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def hot_rows(spark, n=60_000):
    """Half the rows have one key; the others have one of a thousand."""
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1000))
    return spark.range(0, n, 1, 8).select("id", key.alias("key"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_hot_media_name(spark, small_limits):
    refs = hot_rows(spark).select("id", F.lit(0).alias("pos"), F.concat("key", F.lit(".jpg")).alias("ref"))
    listing = refs.select(
        F.lit("folder").alias("place"), F.concat_ws("/", F.lit("/d"), "id", "ref").alias("path"),
        F.col("ref").alias("name"),
    )
    rows, plan = final_plan(op.resolve_media(refs, listing))
    assert "skew=true" in plan
    assert len(rows) == 60_000 and len({r.id for r in rows}) == 60_000
    assert len({r.path for r in rows if r.ref == "hot.jpg"}) == 1


def test_hot_readable_name(spark, small_limits):
    df = hot_rows(spark).select("id", F.concat("key", F.lit(".jpg")).alias("image"))
    listing = df.where("id % 3 <> 1").select(
        F.lit("zip").alias("place"), F.col("image").alias("path"), F.col("image").alias("name")
    )
    rows, plan = final_plan(op.keep_readable(df, "id", ["image"], listing))
    assert "skew=true" in plan
    known = {r.name for r in listing.select("name").distinct().collect()}
    assert len(rows) == df.where(F.col("image").isin(*known)).count()


def test_hot_row_of_media(spark, small_limits):
    """One conversation has half of all images."""
    images = hot_rows(spark).select(
        F.col("key").alias("c"), F.col("id").alias("pos"),
        F.concat(F.lit("/d/"), "id").alias("path"), F.lit("image").alias("kind"),
    )
    talks = images.select("c").distinct().withColumn("conversations", F.array())
    talks = spark.createDataFrame(talks.collect(), talks.schema)
    rows, plan = final_plan(op.pair_media(talks, "c", images))
    assert "skew=true" in plan
    assert len({r.image for r in rows}) == len(rows) == 60_000


def test_hot_batch(spark, small_limits):
    df = hot_rows(spark).withColumn("t", F.repeat(F.lit("x"), (F.col("id") % 13).cast("int")))
    rows, plan = final_plan(op.pad_to_multiple(op.tokenize(df, "t"), 0, batch_col="key"))
    assert "skew=true" in plan
    assert len(rows) == 60_000
    assert {len(r.input_ids) for r in rows if r.key == "hot"} == {16}


def test_hot_model(spark, small_limits):
    card = hot_rows(spark).select(F.col("key").alias("model"), F.col("id").cast("string").alias("dataset"), F.lit("").alias("info"))
    models = spark.range(2000).select(F.concat(F.lit("k"), F.col("id")).alias("model"))
    datasets = spark.range(30).select(F.concat(F.lit("new"), F.col("id")).alias("dataset"))
    rows, plan = final_plan(op.upsert_manifest(card, models, datasets))
    assert "skew=true" in plan
    assert sum(r.model == "hot" for r in rows) == 30_000
    assert len(rows) == 30_000 + 2000 * 30


def test_hot_conversation(spark, small_limits):
    df = hot_rows(spark).select(
        F.col("key").alias("c"), F.col("id").alias("turn"), F.lit("user").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    rows, plan = final_plan(op.render_turns(df, "c", "turn", "role", "text"))
    assert "skew=true" in plan
    assert len(rows) == 60_000
    assert sum(r.text.endswith("\n\n\n") for r in rows) == len({r.c for r in rows})
