"""Messages: build them, name their roles, say why a conversation is unusable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def message(role: Column, content: Column) -> Column:
    """One message, STRUCT<role STRING, content STRING>."""
    return F.struct(
        role.cast("string").alias("role"), content.cast("string").alias("content")
    )


def canonical_role(role: Column, default: str | None = None) -> Column:
    """system / user / assistant by the first word list found in ``role``.

    A role that matches none gives ``default``.
    """
    result = None
    for name, words in fixed.ROLE_WORDS.items():
        found = role.rlike("(?iu)" + "|".join(words))
        result = F.when(found, name) if result is None else result.when(found, name)
    return result.otherwise(F.lit(default).cast("string"))


def build_prompt(user_text: Column) -> Column:
    """The two-message conversation asked at inference time."""
    return F.array(
        message(F.lit("system"), F.lit(fixed.PROMPT_SYSTEM)),
        message(F.lit("user"), user_text),
    )


def reject_reason(messages: Column) -> Column:
    """Why this conversation cannot be rendered; null when it can.

    ``array_join`` skips nulls, so a null role or content has to be caught here
    or it would vanish from the rendered text.
    """
    incomplete = F.exists(
        messages,
        lambda m: m.isNull() | m["role"].isNull() | m["content"].isNull(),
    )
    return F.when(messages.isNull(), "no conversation").when(
        incomplete, "null role or content"
    )
