"""Language identification: held-out accuracy and odd cases."""

import pytest
from pyspark.sql import functions as F

from parley.llm import langid
from parley.llm.langid import MARGIN, Classifier, dictionaries, held_out, identify


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    blind = docs.select("doc_id", "text")
    found = identify(blind, docs.filter(~held_out())).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out())
    n, right, kept = found.agg(
        F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("accepted").cast("int"))
    ).first()
    assert right / n > 0.97 and kept / n > 0.97


def test_held_out_is_crc_of_the_id(spark):
    import zlib

    rows = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_odd_rows(spark):
    learn = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "fr"), (4, "123", "es"), (5, "text", None)],
        "doc_id long, text string, lang string",
    )
    rows = [(1, "the dog and the cat " * 5), (2, "die Katze und der Hund " * 5), (None, None), (4, ""), (4, ""), (5, "12 ½ ---"),
            (6, "the dog " * 40_000), (7, "q")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double")
    found = identify(df, learn).select("doc_id", "lang_pred", "score", "accepted", F.col("row.score").alias("old")).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and all(r.old == 0.5 for r in found)
    assert by[1].lang_pred == "en" and by[2].lang_pred == "de" and by[6].lang_pred in ("de", "en")
    for i in (None, 4, 5):
        assert (by[i].lang_pred, by[i].score, by[i].accepted) == ("und", 0.0, False)
    assert by[7].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in found)


def test_nothing_learned(spark):
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([], schema)
    df = spark.createDataFrame([(1, "some text", "en")], schema)
    assert identify(df, none).first().lang_pred == "und"
    assert identify(none, df).count() == 0
    assert identify(df, df).first().lang_pred == "en"


def test_long_texts_are_accepted(spark):
    """The margin of a text of several megabytes is that of its parts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    classifier = Classifier(dictionaries(docs.filter(~held_out())))
    texts = {}
    for r in docs.filter(held_out()).select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text)
    assert len(texts) > 1
    for lang, own in texts.items():
        whole = "\n".join(own)
        whole *= 1 + 3_000_000 // len(whole)
        for size in (1 << 14, 300_000, 3_000_000):
            found, score = classifier.judge(whole[:size])
            assert found == lang and score > 2 * MARGIN, (lang, size, score)


def test_against_plain_compression(spark):
    """The language whose dictionary leaves the fewest bytes over all pieces of a text, and by how much."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = dictionaries(docs.filter(~held_out()))
    assert len(learned) > 1 and all(len(content) == langid.DICTIONARY for _, content in learned)
    found = identify(docs, docs.filter(~held_out())).filter("doc_id % 9 = 0").select("text", "lang_pred", "score").collect()
    assert len(found) > 50
    for r in found:
        data, sizes = r.text.lower().encode(), []
        for k, (name, content) in enumerate(learned):
            book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=langid.LEVEL)
            how = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append((sum(len(how.compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE)), k, name))
        sizes.sort()
        if r.lang_pred != langid.UNDETERMINED:
            assert r.lang_pred == sizes[0][2] and r.score == (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def test_sample_reads_all_parts_of_texts_and_copies_are_one(spark):
    texts = [(i, "a" * 5000 + f" ende {i} " * 800, "x") for i in range(60)] + [(7, "copy of one text", "y")] * 3000
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(4)
    by = dict(dictionaries(docs))
    assert b"ende" in by["x"] and by["y"] == b"copy of one text\n"
    assert list(by) == ["y", "x"]  # by labelled rows


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        dictionaries(docs)
    assert len(dictionaries(docs.filter("doc_id < 3"))) == 3


def test_workers_give_back_encoders(spark):
    """Encoders that earlier tasks of a worker keep are gone after packing, and where languages were identified."""
    import time

    import public_tokenizers
    import pyarrow as pa

    from parley.llm.packing import pack_documents
    from parley.llm.tokens import length_histogram

    def kept(batches):
        import os
        import sys

        for _ in batches:
            time.sleep(0.02)
            own = "encoder" in getattr(sys.modules.get("_parley_worker"), "__dict__", {})
            yield pa.record_batch({"pid": pa.array([os.getpid()], pa.int64()), "own": pa.array([own])})

    def owners():
        found = spark.range(0, 96, 1, 96).mapInArrow(kept, "pid long, own boolean").collect()
        return {r.pid for r in found if r.own}

    path = public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(i, f"text of row {i} " * 20, "en") for i in range(960)], schema).repartition(96)
    length_histogram(docs, path).collect()
    assert owners()
    identify(docs, docs.coalesce(1)).collect()
    assert not owners()
    many = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in many}
    try:  # groups for every worker
        for k, v in many.items():
            spark.conf.set(k, v)
        pack_documents(docs, path, group_chars=200).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert not owners()


def test_stages_bound_batches(spark):
    """Texts go to workers a few megabytes at a time, unless the session has a bound of its own."""
    import corpus_pipeline
    import pyarrow as pa

    from parley import session

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"size": pa.array([batch.nbytes], pa.int64())})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('some words ', 600) text", "'en' lang")
    try:
        for _, stage in corpus_pipeline.STAGES[:1]:
            stage(spark, docs, "")
        found = [r.size for r in docs.select("text").mapInArrow(sizes, "size long").collect()]
        assert len(found) > 3 and max(found) < 2 * session.BATCH_BYTES
        spark.conf.set(key, "1g")
        corpus_pipeline.language_id(spark, docs, "")
        assert spark.conf.get(key) == "1g"
    finally:
        spark.conf.unset(key)
