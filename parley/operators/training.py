"""Training rows: tokenise, label, pad."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.prompts import render_chat
from ..functions.tokens import attention_mask, mask_labels, pad_array
from ..session import written
from .conversations import CONVERSATIONS, _as_list, to_conversations, valid_conversations
from .layout import detect_layout
from .media import has_media, keep_readable
from .skew import splittable
from .tokenizers import CodePointTokenizer
from .union import union_datasets


PADS = ("max", "multiple", "none")


class EmptyDataset(ValueError):
    """Nothing in a dataset can be trained on."""


def tokenize(
    df: DataFrame, text_col: str, tokenizer=None, max_length: int | None = fixed.MAX_TEXT_TOKENS
) -> DataFrame:
    """Replace ``text_col`` by input_ids, special_mask and n_tokens.

    n_tokens does not depend on the ids when the tokenizer can count, so a plan that
    needs only lengths never builds a token. An n_tokens column that is there is kept.
    """
    tokenizer = tokenizer or CodePointTokenizer()
    counted = count_tokens(df, text_col, tokenizer, max_length)
    kept = [c for c in counted.columns if c != text_col]
    encoded = counted.select(
        *kept, tokenizer.encode(F.col(text_col), max_length).alias("_encoded")
    )
    rows = encoded.select(*kept, "_encoded.input_ids", "_encoded.special_mask")
    if "n_tokens" not in kept:
        rows = rows.withColumn("n_tokens", F.size("input_ids"))
    return rows


def count_tokens(df: DataFrame, text_col: str, tokenizer, max_length: int | None) -> DataFrame:
    """Add n_tokens, if the tokenizer can count without encoding."""
    count = tokenizer.count(F.col(text_col), max_length)
    if count is None or "n_tokens" in df.columns:
        return df
    return df.withColumn("n_tokens", count)


def label_tokens(df: DataFrame, marks_special: bool = True) -> DataFrame:
    """Add labels: the ids, ignored where the tokenizer put a special token.

    Without special tokens (``marks_special`` false) the labels are the ids.
    """
    ids = F.col("input_ids")
    labels = mask_labels(ids, special=F.col("special_mask")) if marks_special else ids
    return df.withColumn("labels", labels)


def max_tokens(df: DataFrame) -> DataFrame:
    """One row: the longest token row of the dataset."""
    return df.agg(F.max("n_tokens").alias("max_tokens"))


def _pad(df: DataFrame, length, pad_id: int) -> DataFrame:
    """Pad the token columns that are there and add the attention mask."""
    fills = {"input_ids": pad_id, "labels": fixed.IGNORED_LABEL, "special_mask": 1}
    padded = {c: pad_array(F.col(c), length, f) for c, f in fills.items() if c in df.columns}
    padded["attention_mask"] = attention_mask(F.col("input_ids"), length)
    return df.withColumns(padded)


def pad_to_max(df: DataFrame, pad_id: int) -> DataFrame:
    """Pad every row to the longest of the dataset.

    The longest is a scalar subquery: one number for the whole job, no join.
    """
    longest = df.withColumn("_length", max_tokens(df).scalar())
    return _pad(longest, F.col("_length"), pad_id).drop("_length")


def pad_to_multiple(
    df: DataFrame, pad_id: int, multiple: int = fixed.PAD_MULTIPLE, batch_col: str | None = None
) -> DataFrame:
    """Pad to the next multiple: of the row itself, or of the longest row in its batch.

    Row padding needs no shuffle. Batch lengths are aggregated before they are
    joined back, so a large batch is never held as one group.
    """

    def rounded(length):
        return length + F.pmod(-length, F.lit(multiple))

    if batch_col is None:
        return _pad(df, rounded(F.col("n_tokens")), pad_id)
    longest = df.groupBy(F.col(batch_col).alias("_batch"), splittable(batch_col)).agg(
        rounded(F.max("n_tokens")).alias("_length")
    )
    # Rows without a batch are one batch.
    joined = df.join(longest.drop("_follows"), F.col(batch_col).eqNullSafe(F.col("_batch")))
    return _pad(joined, F.col("_length"), pad_id).drop("_length", "_batch")


def batch_by_length(
    df: DataFrame, batch_size: int, order_cols: str | list[str], batch_col: str = "batch"
) -> DataFrame:
    """Number batches of ``batch_size`` rows in order of n_tokens, so that little is padded.

    Rows of one length follow ``order_cols``; where these repeat too, any of the equal rows
    comes first. Rows without a length stand in front, the last batch may be smaller, and an
    empty frame has no batch. Rows are sorted by ranges of length and ``order_cols``, so a
    length that many rows have is split, and written: the ranges come from a sample and may
    not be drawn anew for a lost task. Only the number of rows of each range, one a task,
    passes through the driver.
    """
    if batch_size < 1:
        raise ValueError(f"a batch needs at least one row, not {batch_size}")
    if batch_col in df.columns:
        raise ValueError(f"there is a column {batch_col} already")
    keys = ["n_tokens", *_as_list(order_cols)]
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The lower 33 bits of that id are the place of a row in its partition.
    placed = written(
        ranges.withColumns(
            {
                "_range": F.spark_partition_id(),
                "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
    )
    sizes = sorted(placed.groupBy("_range").count().collect())
    starts = accumulate((size for _, size in sizes), initial=0)
    before = df.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, starts)], "_range INT, _before LONG"
    )
    number = F.col("_before") + F.col("_place")
    return placed.join(F.broadcast(before), "_range").select(
        *(F.col(f"`{c}`") for c in df.columns), ((number - F.pmod(number, F.lit(batch_size))) / batch_size).cast("long").alias(batch_col)
    )


def has_unmasked(df: DataFrame) -> DataFrame:
    """One row: does any label count? A dataset without one is not worth training on."""
    return df.agg(
        F.coalesce(
            F.bool_or(F.exists("labels", lambda x: x != fixed.IGNORED_LABEL)), F.lit(False)
        ).alias("has_unmasked")
    )


def row_counts(df: DataFrame, split_col: str, train: str = "train") -> DataFrame:
    """One row: rows of the training split, and the number of splits."""
    split = F.col(split_col)
    return df.agg(
        F.count_if(split == train).alias("train_rows"), F.count_distinct(split).alias("splits")
    )


def token_rows(
    df: DataFrame,
    id_cols: str | list[str],
    tokenizer=None,
    max_length: int | None = None,
    check: bool = True,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Any supported layout as rows of tokens that are not padded: ids, input_ids, n_tokens,

    labels (of text datasets) and the media columns. ``check`` raises ``EmptyDataset`` as
    soon as no row can be left; it looks for the first row only.
    """
    ids = _as_list(id_cols)
    tokenizer = tokenizer or CodePointTokenizer()
    layout = detect_layout(df.schema, tuple(ids))
    media = list(layout.media)
    if layout.is_native and not media:
        if not isinstance(df.schema[layout.columns[0]].dataType, T.ArrayType):
            raise EmptyDataset("text conversations have to be lists of messages")

    conversations = valid_conversations(to_conversations(df, ids))
    limit = max_length
    if limit is None:
        limit = fixed.MAX_MEDIA_TOKENS if media else fixed.MAX_TEXT_TOKENS
    if media:
        if check and conversations.isEmpty():
            raise EmptyDataset("no conversation of the dataset can be rendered")
        present = F.lit(False)
        for column in media:
            present = present | has_media(conversations, column)
        conversations = conversations.where(present)

    # Counted before the join with the listing, so that the longest row can be found
    # without sending any text through it.
    text = render_chat(F.col(CONVERSATIONS)).alias("_text")
    texts = conversations.select(*ids, *media, text)
    texts = count_tokens(texts, "_text", tokenizer, limit)
    if media and listing is not None:
        texts = keep_readable(texts, ids, media, listing)
        if check and texts.isEmpty():
            raise EmptyDataset("no medium of the dataset can be read")
    rows = tokenize(texts, "_text", tokenizer, limit)
    outputs = ["input_ids", "n_tokens"]
    if not media:
        rows = label_tokens(rows, tokenizer.marks_special)
        outputs.append("labels")
    return rows.select(*ids, *outputs, *media)


def padded_rows(
    rows: DataFrame, tokenizer, pad: str = "max", longest: int | None = None
) -> DataFrame:
    """``token_rows`` with attention_mask, padded and without n_tokens.

    ``longest`` is the longest row if that is known; else it is looked up once.
    """
    if pad not in PADS:
        raise ValueError(f"unknown padding {pad}, expected one of {PADS}")
    if pad == "max" and longest is not None:
        out = _pad(rows, F.lit(longest), tokenizer.pad_id)
    elif pad == "max":
        out = pad_to_max(rows, tokenizer.pad_id)
    elif pad == "multiple":
        out = pad_to_multiple(rows, tokenizer.pad_id)
    else:
        out = rows.withColumn("attention_mask", attention_mask(F.col("input_ids")))
    names = [c for c in rows.columns if c != "n_tokens"]
    names.insert(names.index("input_ids") + 1, "attention_mask")
    return out.select(*names)


@dataclass(frozen=True)
class Measured:
    """Token rows that are written, and what was observed while they were."""

    rows: DataFrame
    n_rows: int
    longest: int
    any_label: bool
    media: tuple[str, ...]


def measured(
    rows: DataFrame, media: tuple[str, ...] = (), write: Callable[[DataFrame], DataFrame] | None = None
) -> Measured:
    """Write ``token_rows`` once; count them, find the longest and look for labels in the same pass.

    ``write`` writes them and returns what it wrote; without it they are kept as they are.
    """
    observation = Observation()
    counts = F.exists("labels", lambda x: x != fixed.IGNORED_LABEL) if "labels" in rows.columns else F.lit(False)
    observed = rows.observe(
        observation,
        F.count(F.lit(1)).alias("n_rows"),
        F.max("n_tokens").alias("longest"),
        F.coalesce(F.bool_or(counts), F.lit(False)).alias("any_label"),
    )
    kept = write(observed) if write else written(observed, fixed.FILE_ROWS)
    found = observation.get
    return Measured(kept, found["n_rows"], found["longest"] or 0, found["any_label"], media)


def united(first: Measured, second: Measured) -> DataFrame:
    """The token rows of two datasets.

    If only one has media the union has, and rows without media are none of its rows.
    """
    if bool(first.media) != bool(second.media):
        return (first if first.media else second).rows
    return union_datasets(first.rows, second.rows, on_clash="string")


def prepare_dataset(
    df: DataFrame,
    id_cols: str | list[str],
    tokenizer=None,
    max_length: int | None = None,
    pad: str = "max",
    check: bool = True,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Any supported layout as training rows.

    Text datasets give input_ids, attention_mask and labels; datasets with media
    give input_ids, attention_mask and the media columns, without labels. ``pad`` is
    "max" (longest row of the dataset), "multiple" (each row for itself, the choice
    for large data) or "none". ``check`` raises ``EmptyDataset`` when no row or no
    label is left; it stops at the first row that has one. Rows without a medium are
    no training rows of a dataset with media, and with a media ``listing`` neither are
    rows whose media cannot be read.
    """
    if pad not in PADS:
        raise ValueError(f"unknown padding {pad}, expected one of {PADS}")
    tokenizer = tokenizer or CodePointTokenizer()
    rows = token_rows(df, id_cols, tokenizer, max_length, check, listing)
    # Tokens that cost much and are read twice are kept.
    costly = tokenizer.count(F.lit(""), max_length) is None
    if pad == "max" and costly:
        rows = written(rows)
    if "labels" in rows.columns and check:
        # Without building a token, if the tokenizer can count.
        counts = (
            F.exists("labels", lambda x: x != fixed.IGNORED_LABEL)
            if costly
            else F.col("n_tokens") > tokenizer.n_special
        )
        if rows.where(counts).isEmpty():
            raise EmptyDataset("no label of the dataset counts")
    return padded_rows(rows, tokenizer, pad)
