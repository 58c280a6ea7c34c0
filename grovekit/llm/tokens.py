"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabulary of a public byte-level BPE for many languages, one "base64 rank" a line; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published splitting pattern of this family of vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return count(text)


def sized(documents: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, keep …); rows with null doc_id are no documents."""
    return documents.where("doc_id is not null").select("doc_id", token_count(F.col("text"), vocabulary).alias("n_tokens"), *keep)
