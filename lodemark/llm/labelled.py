"""A bounded sample of labelled texts for fitting."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, key: str = "doc_id", text: str = "text") -> tuple[list, dict]:
    """[(doc_id, text, label)] in seeded order, and the number of labelled rows of each class; see ``sample_rows``."""
    chosen, classes = sample_rows(docs, labels, label, per_class, max_chars, key, text)
    rows = chosen.collect()
    return sorted(((r["_id"], r["_text"], r["_label"]) for r in rows), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[2], r[1])), classes


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict]:
    """Rows (_id, _text, _label) of a bounded sample, and the number of labelled rows of each class.

    Of each class (0 and 1), the first ``per_class`` rows in order of a hash of the id, of which those stay whose texts together
    have ``max_chars`` / 2 characters at most (all rows of an id count, and each as one more); ids of the held-out fold and null ids and labels are left out. These two bounds
    are the most that a fit sees. Texts are found by a join with the ids alone (broadcast: 2 x per_class rows at most).
    """
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fold(key) != 0)).select(F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).distinct()
    classes = {r["_label"]: r["n"] for r in usable.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    order = F.md5(F.col("_id").cast("string"))
    ids = None
    for c in (0, 1):
        part = usable.filter(F.col("_label") == c).orderBy(order, "_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    own = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(ids), "_id")
    sizes = own.groupBy("_id", "_label").agg(F.sum(F.length("_text") + 1).alias("n")).collect()
    room, chosen = {0: max_chars // 2, 1: max_chars // 2}, set()
    for r in sorted(sizes, key=lambda r: (hashlib.md5(str(r["_id"]).encode()).hexdigest(), r["_label"])):
        if r["n"] <= room[r["_label"]]:
            room[r["_label"]] -= r["n"]
            chosen.add((r["_id"], r["_label"]))
    keep = docs.sparkSession.createDataFrame([(i, c) for i, c in sorted(chosen)], "_id long, _label int")
    return own.join(F.broadcast(keep), ["_id", "_label"], "left_semi").select("_id", "_text", "_label"), classes
