import oracle
import pytest
from pyspark.sql import functions as F

from parley import functions as fn
from parley import operators as op
from parley.operators.training import EmptyDataset
from parley.plans import inference_prompts

TEXTS = ["", "a", "héllo", "日本語😀!", "x" * 40, " \n"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")


@pytest.mark.parametrize("bos, eos", [(None, None), (1, None), (None, 2), (1, 2)])
@pytest.mark.parametrize("limit", [None, 5, 1])
@pytest.mark.parametrize("in_jvm", [False, True])
def test_code_points(spark, bos, eos, limit, in_jvm):
    tokenizer = op.CodePointTokenizer(bos_id=bos, eos_id=eos, in_jvm=in_jvm)
    n_special = (bos is not None) + (eos is not None)
    rows = op.label_tokens(op.tokenize(frame(spark), "t", tokenizer, limit)).collect()
    for row in rows:
        codes = [ord(c) for c in TEXTS[row.id]]
        if limit is not None:
            codes = codes[: max(limit - n_special, 0)]
        head, tail = [bos] if bos else [], [eos] if eos else []
        assert row.input_ids == head + codes + tail
        assert row.special_mask == [1] * len(head) + [0] * len(codes) + [1] * len(tail)
        assert row.n_tokens == len(row.input_ids)
        assert row.labels == [-100] * len(head) + codes + [-100] * len(tail)


@pytest.mark.parametrize("in_jvm", [False, True])
def test_odd_texts(spark, in_jvm):
    df = frame(spark, [None, "a"]).select("id", "t", F.lit(b"a\xffb\xc3").cast("string").alias("broken"))
    tokenizer = op.CodePointTokenizer(in_jvm=in_jvm)
    nulls = op.tokenize(df, "t", tokenizer).orderBy("id").collect()
    assert [r.input_ids for r in nulls] == [None, [97]]
    row = op.tokenize(df, "broken", tokenizer).first()
    assert row.input_ids == [97, 0xFFFD, 98, 0xFFFD] and row.n_tokens == 4


def test_pad_to_max(spark):
    tokenizer = op.CodePointTokenizer(bos_id=1, eos_id=2)
    rows = op.pad_to_max(op.label_tokens(op.tokenize(frame(spark), "t", tokenizer)), 2).collect()
    longest = max(len(t) for t in TEXTS) + 2
    for row in rows:
        ids = [1, *map(ord, TEXTS[row.id]), 2]
        assert row.input_ids == oracle.pad(ids, longest, 2)
        assert row.attention_mask == oracle.pad([1] * len(ids), longest, 0)
        assert row.labels == oracle.pad([-100, *ids[1:-1], -100], longest, -100)
        assert len(row.special_mask) == longest


def test_pad_to_multiple(spark):
    df = frame(spark).withColumn("batch", F.col("id") % 2)
    tokens = op.tokenize(df, "t")
    for row in op.pad_to_multiple(tokens, 0).collect():
        n = len(TEXTS[row.id])
        assert len(row.input_ids) == len(row.attention_mask) == -(-n // 8) * 8
        assert sum(row.attention_mask) == n
    for row in op.pad_to_multiple(tokens, 0, batch_col="batch").collect():
        longest = max(len(TEXTS[i]) for i in range(len(TEXTS)) if i % 2 == row.batch)
        assert len(row.input_ids) == -(-longest // 8) * 8


def test_rows_without_a_batch_are_one_batch(spark):
    df = spark.createDataFrame([(1, "a" * 9, 5), (2, "b", None), (3, "c" * 17, None)], "id INT, t STRING, batch INT")
    out = op.pad_to_multiple(op.tokenize(df, "t"), 0, batch_col="batch")
    assert out.columns == op.pad_to_multiple(op.tokenize(df, "t"), 0).columns
    assert {r.id: len(r.input_ids) for r in out.collect()} == {1: 16, 2: 24, 3: 24}


def test_row_counts(spark):
    df = spark.createDataFrame([("train",)] * 3 + [("test",)] * 2 + [(None,)], "split STRING")
    assert tuple(op.row_counts(df, "split").first()) == (3, 2)
    assert tuple(op.row_counts(df.limit(0), "split").first()) == (0, 0)


def test_pad_token_follows_end_token():
    assert op.CodePointTokenizer().pad_id == 0
    assert op.CodePointTokenizer(eos_id=9).pad_id == 9
    assert op.CodePointTokenizer(eos_id=9, pad_token=3).pad_id == 3


def test_image_slots_and_shift(spark):
    df = spark.createDataFrame([([5, 6, 7], [1, 1, 0]), ([], [])], "ids ARRAY<INT>, am ARRAY<INT>")
    inputs, targets = fn.shift_labels(F.col("ids"), F.col("ids"))
    rows = df.select(
        fn.prefix_labels(F.col("ids"), 2).alias("prefix"),
        fn.prefix_labels(F.col("ids"), 2, fill=9).alias("image"),
        fn.extend_attention(F.col("am"), 2).alias("on"),
        fn.extend_attention(F.col("am"), 2, attend=False).alias("off"),
        fn.left_pad_labels(F.col("ids"), F.lit(5)).alias("left"),
        fn.mask_labels(F.col("ids"), F.col("am")).alias("masked"),
        fn.pad_array(F.col("ids"), 2, 0).alias("longer"),
        fn.truncate(F.col("ids"), 2).alias("cut"),
        inputs.alias("inputs"),
        targets.alias("targets"),
    ).collect()
    assert rows[0].asDict() == {
        "prefix": [-100, -100, 5, 6, 7],
        "image": [9, 9, 5, 6, 7],
        "on": [1, 1, 1, 1, 0],
        "off": [0, 0, 1, 1, 0],
        "left": [-100, -100, 5, 6, 7],
        "masked": [5, 6, -100],
        "longer": [5, 6, 7],
        "cut": [5, 6],
        "inputs": [5, 6],
        "targets": [6, 7],
    }
    assert rows[1].inputs == rows[1].targets == []
    assert rows[1].left == [-100] * 5


def test_default_slot_counts(spark):
    df = spark.createDataFrame([([5],)], "ids ARRAY<INT>")
    row = df.select(fn.prefix_labels(F.col("ids")).alias("a"), fn.extend_attention(F.col("ids")).alias("b")).first()
    assert row.a == [-100] * 257 + [5]
    assert row.b == [1] * 257 + [5]


@pytest.fixture(scope="module")
def library_tokenizer(spark, tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    words = {w: i for i, w in enumerate(["[PAD]", "[BOS]", "[EOS]", "[UNK]", "user", "hi", "there"])}
    tokenizer = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.post_processor = processors.TemplateProcessing(
        single="[BOS] $A [EOS]", special_tokens=[("[BOS]", 1), ("[EOS]", 2)]
    )
    path = str(tmp_path_factory.mktemp("tokenizer") / "words.json")
    tokenizer.save(path)
    return op.LibraryTokenizer.ship(spark, path, pad_id=0)


def test_library_tokenizer(spark, library_tokenizer):
    df = frame(spark, ["hi there", "hi hi hi hi hi", "", "bye", None])
    rows = op.label_tokens(op.tokenize(df, "t", library_tokenizer, 5)).orderBy("id").collect()
    assert [r.input_ids for r in rows] == [[1, 5, 6, 2], [1, 5, 5, 5, 2], [1, 2], [1, 3, 2], None]
    assert [r.special_mask for r in rows][:3] == [[1, 0, 0, 1], [1, 0, 0, 0, 1], [1, 1]]
    assert [r.labels for r in rows][0] == [-100, 5, 6, -100]


def test_preparation_with_library_tokenizer(spark, library_tokenizer):
    df = spark.createDataFrame([(1, "hi", "there"), (2, "hi hi hi", "there")], "id INT, input STRING, output STRING")
    rows = {r.id: r for r in op.prepare_dataset(df, "id", library_tokenizer).collect()}
    assert len(rows[1].input_ids) == len(rows[2].input_ids)
    for row in rows.values():
        assert len(row.input_ids) == len(row.attention_mask) == len(row.labels)
        assert sum(row.attention_mask) <= len(row.input_ids)
        real = [i for i, a in zip(row.input_ids, row.attention_mask) if a]
        assert real[0] == 1 and real[-1] == 2
        for token, attended, label in zip(row.input_ids, row.attention_mask, row.labels):
            assert label == (token if attended and token not in (1, 2) else -100)


def test_text_preparation(spark):
    df = spark.createDataFrame([(1, "q", "a"), (2, "question", "answer"), (3, None, "b")], "id INT, question STRING, answer STRING")
    out = op.prepare_dataset(df, "id")
    assert out.columns == ["id", "input_ids", "attention_mask", "labels"]
    rows = {r.id: r for r in out.collect()}
    assert sorted(rows) == [1, 2]
    text = oracle.render([("user", "q"), ("assistant", "a")])
    assert rows[1].input_ids[: len(text)] == [ord(c) for c in text]
    assert rows[1].labels == [ord(c) for c in text] + [-100] * (len(rows[2].input_ids) - len(text))


def test_limits(spark):
    df = spark.createDataFrame([(1, "q", "a" * 20000, "x.jpg")], "id INT, question STRING, answer STRING, image STRING")
    assert len(op.prepare_dataset(df.drop("image"), "id").first().input_ids) == 1000
    with_media = op.prepare_dataset(df, "id")
    assert with_media.columns == ["id", "input_ids", "attention_mask", "image"]
    assert len(with_media.first().input_ids) == 10000
    assert len(op.prepare_dataset(df, "id", max_length=50).first().input_ids) == 50


def test_nothing_to_train_on(spark):
    df = spark.createDataFrame([(1, None, "a")], "id INT, question STRING, answer STRING")
    with pytest.raises(EmptyDataset):
        op.prepare_dataset(df, "id")
    tokens = op.label_tokens(op.tokenize(frame(spark, [""]), "t", op.CodePointTokenizer(1, 2)))
    assert op.has_unmasked(tokens).first()[0] is False
    assert op.has_unmasked(tokens.where("id < 0")).first()[0] is False


def test_inference_prompts(spark):
    row = inference_prompts(frame(spark, ["why?"]), "id", "t").first()
    assert row.n_tokens == len(row.prompt) == len(row.input_ids)
    assert row.prompt.endswith("why?<|im_end|>")


def test_only_special_tokens_are_nothing_to_train_on(spark):
    df = spark.createDataFrame([(1, "q", "a")], "id INT, question STRING, answer STRING")
    tokenizer = op.CodePointTokenizer(bos_id=1, eos_id=2)
    with pytest.raises(EmptyDataset):
        op.prepare_dataset(df, "id", tokenizer, max_length=2)
    row = op.prepare_dataset(df, "id", tokenizer, max_length=3).first()
    assert row.labels == [-100, 10, -100]


def lengths(spark, values):
    rows = [(i, n, [7] * (n or 0)) for i, n in enumerate(values)]
    return spark.createDataFrame(rows, "id INT, n_tokens INT, input_ids ARRAY<INT>")


@pytest.mark.parametrize("size", [1, 8, 1000])
def test_batches_by_length(spark, size):
    # A third of the rows have one length; some have none.
    values = [9 if i % 3 == 0 else (i * 37) % 101 for i in range(600)] + [None, None]
    out = op.batch_by_length(lengths(spark, values), size, "id").collect()
    order = sorted(range(len(values)), key=lambda i: (-1 if values[i] is None else values[i], i))
    assert {r.id: r.batch for r in out} == {i: at // size for at, i in enumerate(order)}
    assert len(out) == len(values)


def test_batches_by_length_pad_less(spark):
    df = lengths(spark, [(i * 37) % 101 for i in range(600)])
    by_length = op.batch_by_length(df, 8, "id")
    as_they_come = df.withColumn("batch", F.floor(F.col("id") / 8))

    def padding(rows):
        padded = op.pad_to_multiple(rows, 0, batch_col="batch")
        total, real = padded.agg(F.sum(F.size("input_ids")), F.sum("n_tokens")).first()
        return 1 - real / total

    assert padding(by_length) < 0.1 < 0.3 < padding(as_they_come)


def test_batches_by_length_plan(spark):
    df = lengths(spark, [3, 1, 2])
    plan = op.batch_by_length(df, 2, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_batches_by_length_bounds(spark):
    df = lengths(spark, [3, 3])
    assert op.batch_by_length(df.limit(0), 4, "id").collect() == []
    twice = op.batch_by_length(df.unionAll(df), 3, "id").collect()
    assert sorted(r.batch for r in twice) == [0, 0, 0, 1]
    with pytest.raises(ValueError):
        op.batch_by_length(df, 0, "id")
    with pytest.raises(ValueError):
        op.batch_by_length(df, 2, "id", batch_col="n_tokens")
