"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  #: default of the path parameter
# Fixed value: the vocabulary's pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_cache: dict[int, object] = {}


def encoding(data: bytes):
    """The tokenizer from its ranks file's bytes, built once per worker."""
    import tiktoken

    k = hash(data)
    if k not in _cache:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        _cache[k] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _cache[k]


def with_tokens(df: DataFrame, text: str = "text", name: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text`` but with its size in tokens; a null text has none (0).

    The vocabulary (under 1 MB) is read where the plan is built and broadcast, so
    executors need no file.  Whole texts are encoded.
    """
    with open(tokenizer, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(data.value)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int32")

    return df.withColumn(name, count(F.col(text))).drop(text)
