"""Sizes of texts in tokens of a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("TOMELINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern the rank files were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_tokens(text: str, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text))


def with_tokens(df: DataFrame, keys: list[str], text_col: str, path: str = VOCABULARY) -> DataFrame:
    """keys and n_tokens; a null text has 0 tokens. The text itself goes no further than the tokenizer."""
    fields = [*(df.select(*keys).schema.fields)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in batch["__text"]]
            yield batch[keys].assign(n_tokens=counts)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long"])
    return df.select(*keys, F.col(text_col).alias("__text")).mapInPandas(run, schema)
