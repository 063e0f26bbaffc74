"""Sizes of texts in tokens of a public tokenizer, whose folder is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files, on every executor; FOLIOSCOPE_TOKENIZERS names another.
TOKENIZERS = os.environ.get("FOLIOSCOPE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Callable[[Column], Column]:
    """Column function: number of tokens of a text, 0 for null and empty ones."""
    path = f"{folder}/{vocabulary}"

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for batch in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return count
