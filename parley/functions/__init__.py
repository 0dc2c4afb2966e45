"""Column functions: each takes and returns ``Column`` and stays in the JVM."""

from .messages import build_prompt, canonical_role, message, reject_reason
from .names import (
    checkpoint_name,
    dataset_dir,
    formatted_name,
    last_part,
    media_kind,
    route_task,
)
from .prompts import format_chat, normalize_prompt, render_chat
from .tokens import (
    attention_mask,
    extend_attention,
    left_pad_labels,
    mask_labels,
    pad_array,
    prefix_labels,
    shift_labels,
    truncate,
)
from .vectors import decode_text, l2_normalize

__all__ = [
    "attention_mask",
    "build_prompt",
    "canonical_role",
    "checkpoint_name",
    "dataset_dir",
    "decode_text",
    "extend_attention",
    "format_chat",
    "formatted_name",
    "l2_normalize",
    "last_part",
    "left_pad_labels",
    "mask_labels",
    "media_kind",
    "message",
    "normalize_prompt",
    "pad_array",
    "prefix_labels",
    "reject_reason",
    "render_chat",
    "route_task",
    "shift_labels",
    "truncate",
]
