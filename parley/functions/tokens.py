"""Token-row arrays: truncate, pad, mask, label, shift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def _fill(value: int, count: Column | int) -> Column:
    count = F.lit(count) if isinstance(count, int) else count
    return F.array_repeat(F.lit(value).cast("int"), F.greatest(count, F.lit(0)).cast("int"))


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def pad_array(values: Column, length: Column | int, fill: int) -> Column:
    """Pad on the right up to ``length``; longer arrays stay as they are."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(values, _fill(fill, length - F.size(values)))


def attention_mask(ids: Column, length: Column | int | None = None) -> Column:
    """1 for every token, 0 for the padding up to ``length``."""
    ones = _fill(1, F.size(ids))
    if length is None:
        return ones
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ones, _fill(0, length - F.size(ids)))


def mask_labels(
    ids: Column, attention: Column | None = None, special: Column | None = None
) -> Column:
    """Labels: the ids, but ignored at special tokens and at padding."""
    ignored = F.lit(fixed.IGNORED_LABEL)
    labels = ids
    if attention is not None:
        labels = F.zip_with(labels, attention, lambda x, a: F.when(a == 0, ignored).otherwise(x))
    if special is not None:
        labels = F.zip_with(labels, special, lambda x, s: F.when(s == 1, ignored).otherwise(x))
    return labels


def prefix_labels(
    ids: Column, n: int = fixed.IMAGE_SLOTS, fill: int = fixed.IGNORED_LABEL
) -> Column:
    """Labels with ``n`` image slots in front."""
    return F.concat(_fill(fill, n), ids)


def extend_attention(
    attention: Column, n: int = fixed.IMAGE_SLOTS, attend: bool = True
) -> Column:
    """Attention mask with ``n`` image slots in front, attended to or not."""
    return F.concat(_fill(1 if attend else 0, n), attention)


def left_pad_labels(labels: Column, length: Column) -> Column:
    """Labels moved right so that they are ``length`` long."""
    return F.concat(_fill(fixed.IGNORED_LABEL, length - F.size(labels)), labels)


def shift_labels(ids: Column, labels: Column) -> tuple[Column, Column]:
    """Next-token pairs: inputs without the last token, labels without the first."""
    keep = F.greatest(F.size(ids) - 1, F.lit(0))
    keep_labels = F.greatest(F.size(labels) - 1, F.lit(0))
    return F.slice(ids, F.lit(1), keep), F.slice(labels, F.lit(2), keep_labels)
