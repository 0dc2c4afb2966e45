"""Encoder, length histogram and packing against the tokenizer itself and plain Python."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm.packing import best_fit, pack, pack_documents
from parley.llm.tokens import WordEncoder, length_histogram, length_quantiles, suffix_sums, truncated_totals, vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "x<|endoftext|>y z <|startoftext|>", "É é Ú NAÏVE naïve é ﬁ ①½ 'S it's don't we'll I'M a.b.c U.S.A., ...!!! 3,14",
    "ΣΑΣ ς x\u00a0y\u3000z İstanbul ß ẞ 中文字 🙂🙂 a🙂b ªº µ", "abc!? --- ###$$$ l'été qu'il 'tis rock'n'roll word'S,",
    "\x00\x01 \x7f a\x0bb\x1cc\x85d", "", " \n\t", "y" * 5000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_tokenizer(spark, tokenizer):
    encoder = WordEncoder(vocabulary(PATH))
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in [*texts, *ODD]:
        assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == ids_of(tokenizer, text), text[:60]
    assert encoder.ids(None) == b""


def test_histogram_and_sums(spark, tokenizer):
    rows = [(1, t) for t in ODD] + [(2, None), (3, "one two three"), (3, "one two three"), (None, "x " * 3000)]
    lengths = np.array([len(ids_of(tokenizer, t)) for _, t in rows])
    df = spark.createDataFrame(rows, "length long, text string")
    sums = suffix_sums(length_histogram(df, PATH))
    found = {r.length: r for r in sums.collect()}
    assert set(found) == set(lengths.tolist())
    for limit, r in found.items():
        assert r.n_docs == (lengths == limit).sum() and r.docs_below == (lengths < limit).sum()
        assert r.docs_from == (lengths >= limit).sum() and r.tokens_from == lengths[lengths >= limit].sum()
        assert r.n_longer == (lengths > limit).sum() and r.tokens_kept == np.minimum(lengths, limit).sum()
        assert r.tokens_total == lengths.sum() and r.docs_total == len(lengths)
    for r in truncated_totals(sums, [0, 5, 2048, 10**6]).collect():
        assert r.n_longer == (lengths > r.context_limit).sum()
        assert r.tokens_kept == np.minimum(lengths, r.context_limit).sum()
        assert r.tokens_cut == lengths.sum() - r.tokens_kept
    ordered = np.sort(lengths)
    for r in length_quantiles(sums, [0.25, 0.5, 0.9, 1.0]).collect():
        assert r.length == ordered[int(np.ceil(r.share * len(ordered))) - 1]


def test_empty_histogram(spark):
    sums = suffix_sums(length_histogram(spark.createDataFrame([], "text string"), PATH))
    assert sums.count() == 0
    assert truncated_totals(sums, [5]).first().tokens_kept == 0


def test_packing_round_trip(spark, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma,", "été"]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(None, "lost"), (7, None), (8, rows[8][1]), (8, rows[8][1]), (900, "word " * 400)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, piece string, part int")
    out = pack_documents(df, PATH, size=128, group_chars=10_000).collect()
    want = sorted((str(i), tuple(ids_of(tokenizer, t) + [0])) for i, t in rows)
    whole: dict = {}
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == 128 * r.piece and 4 * r.length == len(r.ids) and r.length <= 128
        whole.setdefault(str(r.doc_id), []).append(r)
    # rows of one id can be told apart by what their pieces hold
    joined = sorted((i, x) for i, own in whole.items() for r in own for x in [tuple(np.frombuffer(r.ids, "<u4").tolist())] if r.piece == 0)
    assert joined == sorted((i, x[:128]) for i, x in want)
    assert [x for r in sorted(whole["900"], key=lambda r: r.piece) for x in np.frombuffer(r.ids, "<u4").tolist()] == list(dict(want)["900"])
    bins: dict = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_local_search_saves_bins():
    rng = np.random.default_rng(3)
    saved = 0
    for n in (1, 30, 300):
        for _ in range(25):
            lengths = rng.integers(1, 60, n) if rng.random() < 0.5 else rng.integers(20, 51, n)
            bins = pack(lengths, 100)
            assert sorted(i for b in bins for i in b) == list(range(n))
            assert max(lengths[b].sum() for b in bins) <= 100
            start = best_fit(lengths, 100)
            assert len(bins) <= len(start)
            saved += len(start) - len(bins)
    assert saved > 0
    assert pack(np.array([], np.int64), 10) == []
    # best fit in decreasing order needs one more bin than two exchanges of one for one
    assert len(pack(np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 20]), 100)) == 2
