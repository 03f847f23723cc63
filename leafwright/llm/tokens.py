"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("LEAFWRIGHT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def token_counter(path: str = TOKENIZER):
    """Arrow UDF text -> token count. Null counts 0. A worker without the vocabulary file fails, as any other count would mix units."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if not os.path.exists(path):
            raise FileNotFoundError(f"no vocabulary at {path}; every executor needs it (LEAFWRIGHT_TOKENIZER names another)")
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for s in parts:
            yield pd.Series([len(e.ids) for e in tok.encode_batch(s.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return count


def with_sizes(docs: DataFrame, text: str = "text", size: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """`docs` with `size` filled: the stored count where it is there and not negative, else a count of the text.

    Only rows without a stored count pass through Python.
    """
    known = F.col(size).isNotNull() & (F.col(size) >= 0)
    have = docs.where(known).drop(text)
    lack = docs.where(~known | F.col(size).isNull()).withColumn(size, token_counter(path)(F.col(text))).drop(text)
    return have.unionByName(lack)

