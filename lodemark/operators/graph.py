"""Connected components of a link table by alternating large-star and small-star rounds, all in joins and minima.

Links never leave the executors. A node's links are never gathered in one row: each round takes minima by key (combined
before the shuffle) and joins them back under salted keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.storage import discard, save


def _with_least(links: DataFrame, least: DataFrame, salts: int = 16) -> DataFrame:
    """``links`` with ``m`` of their ``a``; a node with many links is ``salts`` keys."""
    spread = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return links.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")).join(spread, ["a", "_salt"]).drop("_salt")


def _large(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return _with_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Links go from larger to smaller; the smaller neighbours of a node, and the node, are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = _with_least(links, least).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node with a link in ``links`` (a, b: longs); root is the least node of its component.

    Links from a node to itself and repeated links don't matter; an empty table gives no rows.
    """
    now = save(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        stars = save(_large(now), "links")
        discard(now)
        now = save(_small(stars), "links")
        discard(stars)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
