"""Conversations: build them from any layout, fold them from turns, filter them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.messages import message, reject_reason
from ..functions.prompts import render_chat
from .layout import Layout, UnsupportedLayout, detect_layout
from .skew import splittable

CONVERSATIONS = "conversations"

_MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)


def _as_list(id_cols: str | list[str] | tuple[str, ...]) -> list[str]:
    return [id_cols] if isinstance(id_cols, str) else list(id_cols)


def _message_reader(data_type: T.DataType):
    """How to read (role, content) out of one message of this type."""
    if isinstance(data_type, T.MapType):

        def first_key(m: Column, keys: tuple[str, ...]) -> Column:
            value = F.lit(None).cast("string")
            for key in reversed(keys):
                value = F.when(F.map_contains_key(m, key), m[key]).otherwise(value)
            return value

        return lambda m: message(
            first_key(m, fixed.ROLE_KEYS), first_key(m, fixed.CONTENT_KEYS)
        )

    if isinstance(data_type, T.StructType):
        names = data_type.fieldNames()
        role = next((k for k in fixed.ROLE_KEYS if k in names), None)
        content = next((k for k in fixed.CONTENT_KEYS if k in names), None)
        if role and content:
            return lambda m: F.when(
                m.isNotNull(), message(m.getField(role), m.getField(content))
            )
    raise UnsupportedLayout(f"messages of type {data_type.simpleString()}")


def normalize_messages(df: DataFrame, col: str = CONVERSATIONS) -> DataFrame:
    """``col`` as ARRAY<STRUCT<role, content>>, whatever its message keys are.

    A column holding one message instead of a list becomes a list of one.
    """
    data_type = df.schema[col].dataType
    column = F.col(col)
    if data_type.simpleString() == _MESSAGES.simpleString():
        return df
    if isinstance(data_type, T.ArrayType):
        return df.withColumn(col, F.transform(column, _message_reader(data_type.elementType)))
    single = _message_reader(data_type)(column)
    return df.withColumn(col, F.when(column.isNotNull(), F.array(single)))


def _messages_of(layout: Layout) -> Column:
    cols = [F.col(f"`{c}`") for c in layout.columns]
    roles = {
        "instruction": ("system", "user", "assistant"),
        "question": ("user", "assistant"),
        "preference": ("user", "assistant"),
    }
    if layout.kind in roles:
        return F.array(*[message(F.lit(r), c) for r, c in zip(roles[layout.kind], cols)])
    if layout.kind == "role_text":
        return F.array(message(cols[0], cols[1]))
    return F.array(
        message(F.lit("user"), F.lit(fixed.IMAGE_QUESTION)),
        message(F.lit("assistant"), cols[0]),
    )


def to_conversations(
    df: DataFrame, id_cols: str | list[str], distinct_columns: bool = False
) -> DataFrame:
    """Any supported layout as a table with a ``conversations`` column.

    A table that already holds conversations keeps all its columns. From the other
    layouts only the ids, the conversations and the media columns remain, and rows
    with a null medium go.
    """
    ids = _as_list(id_cols)
    layout = detect_layout(df.schema, tuple(ids), distinct_columns)
    if layout.is_native:
        named = df.withColumnRenamed(layout.columns[0], CONVERSATIONS)
        return normalize_messages(named)
    built = df
    for medium in layout.media:
        built = built.where(F.col(f"`{medium}`").isNotNull())
    return built.select(*ids, _messages_of(layout).alias(CONVERSATIONS), *layout.media)


def turns_needed(max_length: int, least_tokens: int = 1) -> int:
    """How many turns hold the first ``max_length`` tokens, if none has fewer than ``least_tokens``."""
    return max(1, -(-max_length // least_tokens))


def fold_turns(
    df: DataFrame,
    id_col: str,
    turn: str,
    role: str,
    content: str,
    max_turns: int | None = None,
) -> DataFrame:
    """(id, conversations): one row per conversation from a table with one row per turn.

    ``turn`` orders the turns, role and content those of one number. The plan is the same
    for every size: one shuffle by id.

    ``max_turns`` keeps the first turns of each conversation, which token rows of a limited
    length need (``turns_needed``). Every task drops the others before the shuffle, so a
    conversation with a third of all turns is no hot key. Without it a row holds its whole
    conversation; for conversations that fit no row, see ``render_turns`` and
    ``reject_turns``, which never bring a conversation together.
    """
    rows = df.select(id_col, turn, role, content)
    if max_turns is not None:
        position = F.row_number().over(Window.partitionBy(id_col).orderBy(turn, role, content))
        rows = rows.withColumn("_n", position).where(F.col("_n") <= max_turns)
    turns = F.sort_array(F.collect_list(F.struct(turn, role, content)))
    messages = F.transform(turns, lambda m: message(m[role], m[content]))
    return rows.groupBy(id_col).agg(messages.alias(CONVERSATIONS))


def render_turns(
    df: DataFrame,
    id_col: str,
    turn: str,
    role: str,
    content: str,
    add_generation_prompt: bool = False,
) -> DataFrame:
    """(id, turn, text): what each turn adds to the rendered text of its conversation.

    In the order of turns the texts add up to ``render_chat`` of the whole conversation. A
    conversation is known by its first and last turn, which are aggregated in every task
    first and joined back, so there is no limit to its length. Turn numbers are unique in a
    conversation.
    """
    ends = df.groupBy(F.col(id_col).alias("_id"), splittable(id_col)).agg(
        F.min(turn).alias("_first"), F.max(turn).alias("_last")
    )
    joined = df.join(ends, F.col(id_col).eqNullSafe(F.col("_id")))
    is_first, is_last = F.col(turn) == F.col("_first"), F.col(turn) == F.col("_last")
    single = F.array(message(F.col(role), F.col(content)))
    text = render_chat(
        single, add_generation_prompt=add_generation_prompt, is_first=is_first, is_last=is_last
    )
    return joined.select(id_col, turn, text.alias("text"))


def reject_turns(df: DataFrame, id_col: str, role: str, content: str) -> DataFrame:
    """(id, reject_reason) of conversations that cannot be rendered, from single turns."""
    single = F.array(message(F.col(role), F.col(content)))
    return (
        df.groupBy(id_col)
        .agg(F.max(reject_reason(single)).alias("reject_reason"))
        .where(F.col("reject_reason").isNotNull())
    )


def valid_conversations(df: DataFrame, col: str = CONVERSATIONS) -> DataFrame:
    """Rows whose conversation can be rendered."""
    return df.where(reject_reason(F.col(col)).isNull())


def split_rejects(df: DataFrame, col: str = CONVERSATIONS) -> tuple[DataFrame, DataFrame]:
    """(good rows, other rows with a ``reject_reason``)."""
    marked = df.withColumn("reject_reason", reject_reason(F.col(col)))
    bad = marked.where(F.col("reject_reason").isNotNull())
    return valid_conversations(df, col), bad
