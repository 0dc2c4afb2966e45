"""Encoding by distinct chunks against the library itself."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from parley.llm.pieces import Model, chunks_of, cuts, encode_texts, marked

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "\n\n \n a", "  x  y ", "a▁b ▁ c", "tab\tx\r\ny", "\x00 a\x00", "🙂 é▁\n▁", "<s> </s><unk>",
    "x" * 20_000, "中文字 一 二", " \n", "a \nb", "\n a", "\xa0x　y", "é ﻿x �", "word " * 30_000, "▁", "",
]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(1)
    parts = [" ", "\n", "\r", "▁", "a", "b", "the ", "é", "🙂", "\t", ".", "in", "g", "　", ");"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]


def test_chunks_are_segmented_alone(library):
    model, pattern = Model(open(PATH, "rb").read()), chunks_of(cuts(open(PATH, "rb").read()))
    for text in filter(None, texts()):
        chunks = pattern.findall(marked(text.encode()))
        assert b"".join(chunks) == marked(text.encode())
        assert [i for ids in model.segment(chunks) for i in ids] == library.encode(text)
    only = chunks_of(b" ")
    for text in filter(None, texts()):
        chunks = only.findall(marked(text.encode()))
        assert [i for ids in model.segment(chunks) for i in ids] == library.encode(text)


# ordinary blocks, and blocks and buckets of few bytes: many of each
@pytest.mark.parametrize("block_bytes,bucket_text", [(1 << 24, 1 << 24), (200, 20_000)])
def test_ids_and_texts(spark, library, block_bytes, bucket_text):
    rows = [(i if i % 7 else None, t, 1, "q", None) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, block string, row string")
    got = encode_texts(df, PATH, block_bytes=block_bytes, bucket_text=bucket_text).collect()
    want = sorted((str(i), (x := library.encode(t or "")), library.decode(x) if x else "") for i, t, *_ in rows)
    assert sorted((str(r.row.doc_id), list(r.ids), r.decoded) for r in got) == want
    assert all(r.row.ids == 1 and r.row.block == "q" and r.row.row is None for r in got)


def test_empty_and_null_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_texts(df, PATH).count() == 0
    got = encode_texts(spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string"), PATH).collect()
    assert [(r.ids, r.decoded, r.row.doc_id) for r in got] == [([], "", None)] * 2


def test_other_models_are_refused():
    def changed(change) -> bytes:
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(open(PATH, "rb").read())
        change(proto)
        return proto.SerializeToString()

    def crossing(proto):
        proto.pieces[300].piece = "of▁the"

    def squeezed(proto):
        proto.normalizer_spec.remove_extra_whitespaces = True

    for change in (crossing, squeezed):
        with pytest.raises(ValueError):
            cuts(changed(change))

    def lines(proto):
        proto.pieces[300].piece = "a\n"

    assert cuts(changed(lines)) == b" " and cuts(changed(lambda p: None)) == b" \n"
