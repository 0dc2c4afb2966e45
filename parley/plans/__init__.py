"""Whole flows: from raw datasets to training rows and prompts."""

from .prepare import directory_source, prepare_all, training_card, training_inputs
from .prompting import inference_prompts

__all__ = ["directory_source", "inference_prompts", "prepare_all", "training_card", "training_inputs"]
