"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how the byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Vocabulary file with one base64 token and its rank per line; it must exist on all executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file, loaded once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts. Special tokens count as ordinary text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(vocabulary, pattern).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
