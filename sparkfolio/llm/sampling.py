"""Bounded samples for fitting models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lowest_hashes(df: DataFrame, key: str, bounds: list[tuple[Column, int]]) -> DataFrame:
    """Rows of df whose key's hash is among the `n` lowest of their part, for each (part, n) in bounds.

    The cut-off hashes are found on the key and the parts' columns alone; the wide columns are read once, for
    the sample.  Rows of a repeated key come together.
    """
    h = F.xxhash64(key)
    cuts = [df.where(part).select(h.alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0] for part, n in bounds]
    live = [part & (h <= F.lit(c)) for (part, _), c in zip(bounds, cuts) if c is not None]
    return df.where(reduce(lambda a, b: a | b, live, F.lit(False)))
