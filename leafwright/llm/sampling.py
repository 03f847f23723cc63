"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def hash_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """About `size` rows, those with the smallest hash of `key`; all where there are fewer. A filter, so nothing is shuffled or gathered."""
    n = rows.count()
    if n <= size:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(_STEPS)) < int(_STEPS * size / n))
