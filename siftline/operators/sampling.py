"""Row samples with an explicit order: all, first, last, random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("all", "first", "last", "random")


def shuffle_key(key: str, seed: int) -> Column:
    """A reproducible pseudo-random order of rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_data(df: DataFrame, mode: str = "all", n: int | None = None, seed: int = 42, order: str = "id") -> DataFrame:
    """All rows, or n of them: the first or last by ``order``, or n drawn without replacement. n null
    or above the number of rows: all rows. Only the n rows reach one task."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "all" or n is None:
        return df
    by = {"first": [F.col(order)], "last": [F.desc(order)], "random": [shuffle_key(order, seed), F.col(order)]}[mode]
    return df.orderBy(*by).limit(n)


def shuffle_rows(df: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    return df.orderBy(shuffle_key(key, seed), key)
