"""Exact dedup by a tree of merged digest runs, in DataFrame operations only.

The rows are dealt to runs by a hash of id and text. Within a run, equal digests meet first; then, in rounds, ``fan_in`` neighbouring runs
are merged into one: their rows are sorted by digest together, and a pass over that order keeps the best identifier of each stretch of equal, verified
digests. So a digest costs one row for each run and round however many copies it has. The winner of the
last round is handed down the same tree: no join or group ever holds more than ``fan_in`` rows of one digest, and at
the bottom no more than one run's share of a group.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.storage import save

from .common import read_table

KEYS = ["digest", "n_bytes", "check"]


def digest_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, SHA-256 and, to verify that equal digests are equal texts, the length and a second, unrelated hash."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("id"), F.unhex(F.sha2(value, 256)).alias("digest"), F.octet_length(value).alias("n_bytes"), F.xxhash64(value).alias("check"))


def merge_tree(rows: DataFrame, keep: str = "max", fan_in: int = 8, rows_per_run: int = 65536) -> DataFrame:
    """``rows`` (id, digest, n_bytes, check) with keep_id and group_size; in one round at least."""
    rounds = max(1, math.ceil(math.log(max(1, rows.count()) / rows_per_run, fan_in)))
    best, first = {"max": (F.max, F.desc_nulls_last), "min": (F.min, F.asc_nulls_last)}[keep]
    base = rows.withColumn("run", F.pmod(F.xxhash64("id", "check"), F.lit(fan_in**rounds)))
    levels = [save(base.groupBy("run", *KEYS).agg(best("id").alias("keep_id"), F.count("*").alias("group_size")).sortWithinPartitions("run", *KEYS), "runs")]
    equal = Window.partitionBy("run", *KEYS)
    for _ in range(rounds):
        merged = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in))
        merged = merged.withColumns({"place": F.row_number().over(equal.orderBy(first("keep_id"))), "group_size": F.sum("group_size").over(equal)})
        levels.append(save(merged.filter("place = 1").drop("place"), "runs"))
    won = levels.pop()
    for lower in reversed(levels):
        below = lower.select("run", *KEYS, F.floor(F.col("run") / fan_in).alias("upper"))
        won = below.join(won.withColumnRenamed("run", "upper"), ["upper", *KEYS]).select("run", *KEYS, "keep_id", "group_size")
    return base.join(won, ["run", *KEYS]).drop("run")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max", fan_in: int = 8, rows_per_run: int = 65536) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. The row with the largest (or smallest) id stays.
    Rows that repeat an id count each in group_size and share the fate of their id. A null id never wins over an
    id; where a group has no id at all, keep_id is null and its rows are kept. Texts of any length count whole. Empty tables give no rows; other
    columns, whatever their names, aren't read.
    """
    rows = save(digest_rows(docs, key, text), "digests")
    return merge_tree(rows, keep, fan_in, rows_per_run).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
