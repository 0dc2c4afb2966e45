"""DataFrame operators. Every one takes and keeps explicit id columns."""

from .catalog import (
    filter_files,
    record_configs,
    resolve_config,
    select_split,
    upsert_manifest,
)
from .conversations import (
    fold_turns,
    reject_turns,
    render_turns,
    turns_needed,
    normalize_messages,
    split_rejects,
    to_conversations,
    valid_conversations,
)
from .layout import Layout, UnsupportedLayout, detect_layout
from .media import explode_media, keep_readable, pair_media, pair_media_grouped, resolve_media
from .tokenizers import CodePointTokenizer, LibraryTokenizer
from .training import (
    EmptyDataset,
    batch_by_length,
    has_unmasked,
    label_tokens,
    max_tokens,
    pad_to_max,
    pad_to_multiple,
    prepare_dataset,
    row_counts,
    tokenize,
)
from .union import TypeClash, column_set, common_type, union_datasets

__all__ = [
    "CodePointTokenizer",
    "EmptyDataset",
    "Layout",
    "LibraryTokenizer",
    "TypeClash",
    "UnsupportedLayout",
    "batch_by_length",
    "column_set",
    "common_type",
    "detect_layout",
    "explode_media",
    "filter_files",
    "fold_turns",
    "reject_turns",
    "render_turns",
    "turns_needed",
    "has_unmasked",
    "keep_readable",
    "label_tokens",
    "max_tokens",
    "normalize_messages",
    "pad_to_max",
    "pad_to_multiple",
    "pair_media",
    "pair_media_grouped",
    "prepare_dataset",
    "record_configs",
    "resolve_config",
    "resolve_media",
    "row_counts",
    "select_split",
    "split_rejects",
    "to_conversations",
    "tokenize",
    "union_datasets",
    "upsert_manifest",
    "valid_conversations",
]
