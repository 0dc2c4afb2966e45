import random

import oracle
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley import fixed
from parley import functions as fn
from parley.functions import prompts

MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"


@pytest.mark.parametrize("add", [False, True])
def test_rendering(spark, add):
    cases = [
        [],
        [("user", "hi")],
        [("system", "be brief"), ("user", "hi")],
        [("user", "a"), ("system", "b"), ("assistant", "")],
        [("System", "not the exact word"), ("user", "\n\n")],
    ]
    df = spark.createDataFrame(list(enumerate(cases)), f"id INT, ms {MESSAGES}")
    text = fn.render_chat(F.col("ms"), add_generation_prompt=add)
    got = {r.id: r.t for r in df.select("id", text.alias("t")).collect()}
    assert got == {i: oracle.render(c, add) for i, c in enumerate(cases)}


def test_image_tags(spark):
    df = spark.createDataFrame(
        [([("system", "s"), ("user", "look")], [None, ["a.png", "b.png"]])],
        f"ms {MESSAGES}, images ARRAY<ARRAY<STRING>>",
    )
    got = df.select(fn.render_chat(F.col("ms"), images=F.col("images"))).first()[0]
    tags = "<images>a.png</images><images>b.png</images>"
    assert got == oracle.render([("system", "s"), ("user", "look" + tags)])


def random_texts(n=4000):
    rng = random.Random(7)
    alphabet = list(fixed.WHITESPACE) + list("ab<>:s|\n\n\t  ") + ["assistant", "im_start", "é", "😀"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(0, 14))) for _ in range(n)]


def test_whitespace_class_is_python_whitespace():
    import sys

    spaces = {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}
    assert set(fixed.WHITESPACE) == spaces


def test_normalisation_of_random_texts(spark):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    rows = df.select(
        "id",
        prompts.strip_line_ends(F.col("t")).alias("lines"),
        prompts.collapse_blank_lines(F.col("t")).alias("blanks"),
        prompts.strip_ends(F.col("t")).alias("ends"),
        prompts.ensure_assistant_turn(prompts.strip_ends(F.col("t"))).alias("open"),
        fn.normalize_prompt(F.col("t")).alias("all"),
    ).collect()
    for row in rows:
        text = texts[row.id]
        assert row.lines == oracle.strip_line_ends(text), repr(text)
        assert row.blanks == oracle.collapse_blank_lines(text), repr(text)
        assert row.ends == text.strip(), repr(text)
        assert row.open == oracle.open_turn(text.strip()), repr(text)
        assert row.all == oracle.normalize(text), repr(text)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=40))
def test_normalisation_of_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    got = {r.id: r.p for r in df.select("id", fn.normalize_prompt(F.col("t")).alias("p")).collect()}
    assert got == {i: oracle.normalize(t) for i, t in enumerate(texts)}


def test_prompt_for_a_question(spark):
    df = spark.createDataFrame([("why?  \n\n\n",)], "q STRING")
    got = df.select(fn.format_chat(fn.build_prompt(F.col("q")))).first()[0]
    want = oracle.normalize(
        oracle.render([("system", fixed.PROMPT_SYSTEM), ("user", "why?  \n\n\n")])
    )
    assert got == want


@pytest.mark.parametrize("text", [" " * 200_000 + "x", "a\n" + " " * 200_000 + "x", "a" + " \t" * 100_000 + "\nb", "\n" * 200_000 + "x"])
def test_whitespace_rules_are_linear(spark, text):
    import time

    df = spark.createDataFrame([("x",), (text,)], "t STRING")
    rules = prompts.collapse_blank_lines(prompts.strip_line_ends(F.col("t")))
    df.limit(1).select(rules).collect()
    start = time.perf_counter()
    got = df.select(rules.alias("t")).collect()[1].t
    assert time.perf_counter() - start < 5
    assert got.endswith(text[-1]) and "x\n\n\n" not in got
