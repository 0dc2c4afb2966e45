"""Sources and sinks: datasets, media listings, manifests."""

from .datasets import (
    UnreadFiles,
    output_path,
    positions,
    publish,
    read_dataset,
    read_formatted,
    read_with_rejects,
    stage_formatted,
    with_row_ids,
    withdraw,
    write_formatted,
)
from .listing import media_listing
from .manifest import (
    card_documents,
    parse_card,
    read_configs,
    read_manifest,
    single_document,
    unparsed_configs,
    unparsed_manifest,
    write_configs,
    write_manifest,
)

__all__ = [
    "UnreadFiles",
    "card_documents",
    "media_listing",
    "output_path",
    "parse_card",
    "positions",
    "publish",
    "read_configs",
    "read_dataset",
    "read_formatted",
    "read_manifest",
    "read_with_rejects",
    "single_document",
    "stage_formatted",
    "unparsed_configs",
    "unparsed_manifest",
    "with_row_ids",
    "withdraw",
    "write_configs",
    "write_formatted",
    "write_manifest",
]
