"""The data part of inference: questions to tokenised prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.messages import build_prompt
from ..functions.prompts import format_chat
from ..operators.tokenizers import CodePointTokenizer
from ..operators.training import tokenize


def inference_prompts(
    df: DataFrame, id_cols: str | list[str], user_col: str, tokenizer=None
) -> DataFrame:
    """(ids, prompt, input_ids, special_mask, n_tokens); prompts are not cut."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    prompt = format_chat(build_prompt(F.col(user_col)))
    prompts = df.select(*ids, prompt.alias("prompt")).withColumn("_text", F.col("prompt"))
    return tokenize(prompts, "_text", tokenizer or CodePointTokenizer(), max_length=None)
