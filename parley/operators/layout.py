"""Layout detection: which columns hold the conversation. Reads only the schema."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .. import fixed


class UnsupportedLayout(ValueError):
    """No rule recognises the columns of a dataset."""


@dataclass(frozen=True)
class Layout:
    """``kind`` names the rule; ``columns`` are its inputs in message order."""

    kind: str
    columns: tuple[str, ...]
    media: tuple[str, ...] = field(default=())

    @property
    def is_native(self) -> bool:
        return self.kind in ("conversations", "messages")


def _matching(names: list[str], pattern: str) -> list[str]:
    return [n for n in names if re.search(pattern, n, re.IGNORECASE)]


def _is_message_list(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.ArrayType) and isinstance(
        data_type.elementType, (T.StructType, T.MapType)
    )


def detect_media(schema: T.StructType) -> tuple[str, ...]:
    """Media columns: images, then audios, then videos, each in column order."""
    names = schema.fieldNames()
    return tuple(n for pattern in fixed.MEDIA_NAMES for n in _matching(names, pattern))


def detect_layout(
    schema: T.StructType, id_cols: tuple[str, ...] = (), distinct_columns: bool = False
) -> Layout:
    """The first rule that fits; within a rule the first column that fits.

    ``instruction`` is both a user and a system name, so a table of instruction,
    input, output uses it twice and drops the input. ``distinct_columns`` forbids
    using a column twice.
    """
    names = [n for n in schema.fieldNames() if n not in id_cols]
    media = detect_media(T.StructType([f for f in schema if f.name in names]))

    native = _matching(names, fixed.CONVERSATION_NAMES)
    if native:
        return Layout("conversations", (native[0],), media)

    for pattern in fixed.MESSAGE_NAMES:
        found = _matching(names, pattern)
        if found:
            if _is_message_list(schema[found[0]].dataType):
                return Layout("messages", (found[0],), media)
            break

    def pick(*patterns: str) -> tuple[str, ...] | None:
        chosen: list[str] = []
        for pattern in patterns:
            found = _matching(names, pattern)
            if distinct_columns:
                found = [n for n in found if n not in chosen]
            if not found:
                return None
            chosen.append(found[0])
        return tuple(chosen)

    rules = (
        ("instruction", (fixed.SYSTEM_NAMES, fixed.USER_NAMES, fixed.ASSISTANT_NAMES)),
        ("question", (fixed.USER_NAMES, fixed.ASSISTANT_NAMES)),
        ("preference", (fixed.CHOSEN_NAMES, fixed.REJECTED_NAMES)),
        ("role_text", (fixed.ROLE_NAMES, fixed.TEXT_NAMES)),
        ("caption", (fixed.CAPTION_NAMES,)),
        ("label", (fixed.LABEL_NAMES,)),
    )
    for kind, patterns in rules:
        columns = pick(*patterns)
        if columns:
            return Layout(kind, columns, media)
    raise UnsupportedLayout(f"no layout fits the columns {names}")
