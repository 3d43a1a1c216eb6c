"""Joins that stay even where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def light(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df`` (a few numbers a row, written or cheap to count), marked to be broadcast if it has no more than ``rows``; else Spark chooses."""
    return F.broadcast(df) if df.count() <= rows else df


def join_unique(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, parts: int = 1000) -> DataFrame:
    """``rows`` joined with ``lookup`` (one row a key, none null); ``counts``: key and n, the rows of each key.

    Keys of over one in ``parts`` of all rows, so fewer than ``parts`` keys, are joined by broadcast, wherever their rows are; all others by shuffle.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = lookup.join(F.broadcast(counts.filter(F.col("n") > total / parts).select(key)), key, "left_semi")
    hot = rows.join(F.broadcast(heavy), key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(lookup, key)
    return hot.unionByName(cold)
