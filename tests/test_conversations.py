import oracle
import pytest
from pyspark.sql import functions as F

from parley import fixed
from parley import functions as fn
from parley import operators as op


def pairs(row):
    return None if row is None else [(m.role, m.content) for m in row]


def conversations(df, key="id"):
    return {r[key]: pairs(r.conversations) for r in df.collect()}


def test_native_keeps_all_columns(spark):
    df = spark.createDataFrame(
        [(1, [("user", "a")], "x"), (2, [], "y"), (3, None, "z")],
        "id INT, conversations ARRAY<STRUCT<role: STRING, content: STRING>>, extra STRING",
    )
    out = op.to_conversations(df, "id")
    assert out.columns == ["id", "conversations", "extra"]
    assert conversations(out) == {1: [("user", "a")], 2: [], 3: None}


def test_key_dialects(spark):
    df = spark.createDataFrame(
        [(1, [("human", "a"), ("gpt", "b")])],
        "id INT, Conversation ARRAY<STRUCT<from: STRING, value: STRING>>",
    )
    assert conversations(op.to_conversations(df, "id")) == {1: [("human", "a"), ("gpt", "b")]}

    both = spark.createDataFrame(
        [(1, [("r", "f", "c", "v")])],
        "id INT, messages ARRAY<STRUCT<role: STRING, from: STRING, content: STRING, value: STRING>>",
    )
    assert conversations(op.to_conversations(both, "id")) == {1: [("r", "c")]}

    maps = spark.createDataFrame(
        [(1, [{"from": "u", "content": "a"}, {"role": "s", "value": "b"}, {"value": "c"}])],
        "id INT, messages ARRAY<MAP<STRING, STRING>>",
    )
    assert conversations(op.to_conversations(maps, "id")) == {1: [("u", "a"), ("s", "b"), (None, "c")]}

    single = spark.createDataFrame(
        [(1, ("u", "a")), (2, None)], "id INT, conversations STRUCT<from: STRING, content: STRING>"
    )
    assert conversations(op.to_conversations(single, "id")) == {1: [("u", "a")], 2: None}

    other = spark.createDataFrame(
        [(1, [("a", "b")])], "id INT, messages ARRAY<STRUCT<who: STRING, content: STRING>>"
    )
    with pytest.raises(op.UnsupportedLayout):
        op.to_conversations(other, "id")


def test_media_rows(spark):
    df = spark.createDataFrame(
        [(1, "a.jpg", "cat", 5), (2, None, "dog", 6)], "id INT, image STRING, caption STRING, n INT"
    )
    out = op.to_conversations(df, "id")
    assert out.columns == ["id", "conversations", "image"]
    assert conversations(out) == {
        1: [("user", "What in this images?"), ("assistant", "cat")]
    }


def test_label_becomes_text(spark):
    df = spark.createDataFrame([(1, ["a.jpg"], 7)], "id INT, images ARRAY<STRING>, label INT")
    assert conversations(op.to_conversations(df, "id"))[1][1] == ("assistant", "7")


def test_rejects(spark):
    schema = "id INT, conversations ARRAY<STRUCT<role: STRING, content: STRING>>"
    rows = [
        (1, [("user", "a")]),
        (2, None),
        (3, []),
        (4, [("user", None)]),
        (5, [(None, "a")]),
        (6, [("user", "a"), None]),
    ]
    good, bad = op.split_rejects(spark.createDataFrame(rows, schema))
    assert sorted(r.id for r in good.collect()) == [1, 3]
    assert {r.id: r.reject_reason for r in bad.collect()} == {
        2: "no conversation",
        4: "null role or content",
        5: "null role or content",
        6: "null role or content",
    }


def test_turns_add_up(spark, turns):
    """Texts of single turns, in order, are the text of the conversation."""
    whole = op.fold_turns(turns, "conv_id", "turn", "role", "text")
    for prompt in (False, True):
        text = fn.render_chat(F.col("conversations"), add_generation_prompt=prompt).alias("t")
        want = {r.conv_id: r.t for r in whole.select("conv_id", text).collect()}
        single = op.render_turns(turns, "conv_id", "turn", "role", "text", prompt).collect()
        got = {}
        for row in sorted(single, key=lambda r: (r.conv_id, r.turn)):
            got[row.conv_id] = got.get(row.conv_id, "") + row.text
        assert got == want


@pytest.mark.parametrize("max_turns", [1, 2, 3, 1000])
def test_first_turns(spark, turns, max_turns):
    whole = op.fold_turns(turns, "conv_id", "turn", "role", "text")
    heads = op.fold_turns(turns, "conv_id", "turn", "role", "text", max_turns=max_turns)
    got = {r.conv_id: pairs(r.conversations) for r in heads.collect()}
    full = {r.conv_id: pairs(r.conversations) for r in whole.collect()}
    assert got == {c: ms[:max_turns] for c, ms in full.items()}


def test_a_long_conversation_stays_one(spark):
    """3,000 turns, one null late, next to short ones and one with a null id."""
    hot = spark.range(3000).select(F.lit(7).alias("c"), F.col("id").alias("turn"))
    null = spark.range(2000).select(F.lit(None).cast("int").alias("c"), F.col("id").alias("turn"))
    cold = spark.range(400).select((F.col("id") / 4 + 10).cast("int").alias("c"), F.col("id").alias("turn"))
    content = F.when((F.col("c") == 7) & (F.col("turn") == 2900), None).otherwise(F.col("turn").cast("string"))
    df = hot.union(null).union(cold).withColumns({"role": F.lit("user"), "text": content})
    folded = op.fold_turns(df, "c", "turn", "role", "text")
    sizes = {r.c: len(r.conversations) for r in folded.collect()}
    assert sizes.pop(7) == 3000 and sizes.pop(None) == 2000 and set(sizes.values()) == {4}

    good, bad = op.split_rejects(folded)
    assert [r.c for r in bad.collect()] == [7] and good.count() == 101
    assert [tuple(r) for r in op.reject_turns(df, "c", "role", "text").collect()] == [(7, "null role or content")]

    text = oracle.render([("user", str(i)) for i in range(2000)])
    rendered = op.render_turns(df.where("c IS NULL"), "c", "turn", "role", "text").orderBy("turn").collect()
    assert "".join(r.text for r in rendered) == text
    for limit in (10, 1000, 100_000):
        heads = op.fold_turns(
            df.where("c IS NULL"), "c", "turn", "role", "text", max_turns=op.turns_needed(limit, fixed.LEAST_TURN)
        )
        chat = heads.select("c", fn.render_chat(F.col("conversations")).alias("t"))
        assert op.tokenize(chat, "t", max_length=limit).first().input_ids == [ord(c) for c in text[:limit]]


def test_first_turns_are_cut_before_the_shuffle(spark, turns):
    heads = op.fold_turns(turns, "conv_id", "turn", "role", "text", max_turns=34)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")  # a plan is printed from its end
    copies = spark.range(0, 50_000, 1, 8).select(F.lit(7).alias("c"), F.lit(1).alias("turn"))
    df = copies.withColumns({"role": F.lit("user"), "text": F.col("turn").cast("string")})
    (row,) = op.fold_turns(df, "c", "turn", "role", "text", max_turns=34).collect()
    assert len(row.conversations) == 34


def test_canonical_role(spark):
    roles = ["System", "INSTRUCTIONS", "a user", "Human", "inputs", "gpt-4", "response", "tool", ""]
    df = spark.createDataFrame([(r,) for r in roles], "role STRING")
    got = [r[0] for r in df.select(fn.canonical_role(F.col("role"))).collect()]
    assert got == [
        "system", "system", "user", "user", "user", "assistant", "assistant", None, None
    ]
    got = df.select(fn.canonical_role(F.col("role"), "assistant")).collect()
    assert [r[0] for r in got][-2:] == ["assistant", "assistant"]
