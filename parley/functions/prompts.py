"""Chat text: render conversations and normalise prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

# The gap before every message and after every conversation.
_GAP = "\n\n\n\n"
_DEFAULT_SYSTEM_TURN = (
    f"\n{fixed.MESSAGE_START}system\n{fixed.DEFAULT_SYSTEM}{fixed.MESSAGE_END}\n\n"
)


def _image_tags(images: Column) -> Column:
    tags = F.transform(images, lambda i: F.concat(F.lit("<images>"), i, F.lit("</images>")))
    return F.coalesce(F.array_join(tags, ""), F.lit(""))


def render_chat(
    messages: Column,
    add_generation_prompt: bool = False,
    images: Column | None = None,
    is_first: Column | None = None,
    is_last: Column | None = None,
) -> Column:
    """Chat text of ARRAY<STRUCT<role, content>>.

    ``images``, an ARRAY<ARRAY<STRING>> aligned with the messages, appends image
    tags to each content. ``is_first`` / ``is_last`` are for single turns (see
    ``render_turns``): their texts, in order, add up to the text of the whole
    conversation.
    """
    is_first = F.lit(True) if is_first is None else is_first
    is_last = F.lit(True) if is_last is None else is_last

    def turn(m: Column, tags: Column | None = None) -> Column:
        content = m["content"] if tags is None else F.concat(m["content"], _image_tags(tags))
        return F.concat(
            F.lit("\n" + fixed.MESSAGE_START),
            m["role"],
            F.lit("\n"),
            content,
            F.lit(fixed.MESSAGE_END + "\n\n"),
        )

    if images is None:
        turns = F.transform(messages, lambda m: turn(m))
    else:
        turns = F.zip_with(messages, images, turn)
    opening = F.when(
        is_first & (F.get(messages, F.lit(0))["role"] != "system"),
        _GAP + _DEFAULT_SYSTEM_TURN,
    ).otherwise(_GAP)
    body = F.when(F.size(messages) == 0, "").otherwise(
        F.concat(opening, F.array_join(turns, _GAP))
    )
    closing = "\n"
    if add_generation_prompt:
        closing += f"{fixed.MESSAGE_START}assistant\n"
    return F.concat(body, F.when(is_last, closing).otherwise(""))


def strip_line_ends(text: Column) -> Column:
    """Drop blanks and tabs at the end of every line."""
    # A run is tried once, at its start, and never given back: linear in any text.
    return F.regexp_replace(text, r"(?md)(?<![ \t])[ \t]++$", "")


def collapse_blank_lines(text: Column) -> Column:
    """Turn a run of blank lines into one."""
    return F.regexp_replace(text, rf"\n{fixed.WHITESPACE_CLASS}*\n+", "\n\n")


def strip_ends(text: Column) -> Column:
    """Drop Unicode whitespace at both ends."""
    return F.trim(text, F.lit(fixed.WHITESPACE))


def ensure_assistant_turn(text: Column) -> Column:
    """Open an assistant turn unless the text already shows a chat mark.

    The mark that is looked for is an alternation: a ``<``, the word
    ``im_start``, or ``>assistant:`` at the end.
    """
    marked = (
        text.contains("<")
        | text.contains("im_start")
        | text.rlike(r"(?d)>assistant:s*$")
    )
    return F.when(marked, text).otherwise(
        F.concat(text, F.lit(f"\n{fixed.MESSAGE_START}assistant"))
    )


def normalize_prompt(text: Column) -> Column:
    """Whitespace rules, then the assistant turn."""
    return ensure_assistant_turn(
        strip_ends(collapse_blank_lines(strip_line_ends(text)))
    )


def format_chat(messages: Column) -> Column:
    """Rendered and normalised prompt of one conversation."""
    return normalize_prompt(render_chat(messages))
