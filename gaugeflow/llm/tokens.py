"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level BPE vocabulary as ranks; every executor must have the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, name: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """df without text, with name: the tokens of its whole text; 0 for null and empty texts."""

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary).encode_ordinary
        for part in parts:
            yield pd.Series([len(encode(t)) if t else 0 for t in part], dtype="int64")

    # declared nondeterministic, so that filters on the count aren't pushed down as a second call
    counted = F.pandas_udf(count, "bigint").asNondeterministic()
    return df.withColumn(name, counted(F.col(text))).drop(text)

