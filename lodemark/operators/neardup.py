"""Near-duplicate texts by word shingles and MinHash, without pairs of copies and without lists of pairs in a group.

64 minima stand for a text; two texts are near-duplicates if 90 % of their minima agree, so at most three of 64 differ and one of four bands
of 16 is equal: joining on bands finds every such pair. Texts with the same minima are one class and meet as one row. Within a band, a
task walks the group breadth-first and emits links that span it; large groups are cut into tiles, and each two tiles meet in a task of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.storage import discard, save

from .graph import components
from .skew import join_unique

WORDS, MINIMA, BANDS, AGREE, TITLES, TILE = 3, 64, 4, 61, 0.80, 2048
_RNG = np.random.default_rng(64)
_A, _B = _RNG.integers(1, 2**63, MINIMA, dtype=np.uint64) | np.uint64(1), _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64)


def minima(text: str | None, words: int = WORDS) -> np.ndarray:
    """The least of each of 64 hashes over all shingles of a text; a text of fewer words is one shingle."""
    w = (text or "").lower().encode("utf-8", "replace").split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))), np.uint64)
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        mixed = hashes[k : k + 4096, None] * _A + _B
        out = np.minimum(out, (mixed ^ (mixed >> np.uint64(31))).min(0))
    return out.view(np.int64)


def signature(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def signatures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([minima(t) for t in texts])

    return signatures(text)


def _spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []

    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        ids, sigs, titles, out = group["node"].to_numpy(), np.stack(group["sig"].to_numpy()), group["title"].to_list(), []
        left = np.arange(len(ids))
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = (sigs[left] == sigs[at]).sum(1) >= AGREE
                near[near] = [titled_alike(titles[at], titles[x]) for x in left[near]]
                out += [(ids[at], ids[x]) for x in left[near]]
                queue += left[near].tolist()
                left = left[~near]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    key = ["band", "hash", "u", "v"]
    for batch in batches:
        if held:
            batch = pd.concat([*held, batch], ignore_index=True)
        groups = list(batch.groupby(key, sort=False))
        for _, group in groups[:-1]:
            yield links(group)
        held = [group for _, group in groups[-1:]]
    for group in held:
        yield links(group)


def titled_alike(a: str | None, b: str | None) -> bool:
    """Whether both have no title to compare, or titles whose matching blocks make up ``TITLES`` of them."""
    if a is None or b is None:
        return a is b
    both = SequenceMatcher(None, a, b)
    return both.real_quick_ratio() >= TITLES and both.quick_ratio() >= TITLES and both.ratio() >= TITLES


def _nodes(docs: DataFrame, key: str, text: str, title: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, sig, title, kind), and one row for each kind of equal minima and title: node, least (id), n, sig, title."""
    named = F.lower(F.coalesce(F.col(title), F.lit(""))) if title else F.lit(None).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("id"), signature(F.col(text)).alias("sig"), named.alias("title"))
    rows = save(rows.withColumn("kind", F.xxhash64("sig", "title")), "signatures")
    distinct = rows.groupBy("kind").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.any_value("sig").alias("sig"), F.any_value("title").alias("title"))
    return rows, save(distinct.withColumnRenamed("kind", "node"), "distinct")


def _bands() -> Column:
    size = MINIMA // BANDS
    return F.array(*(F.struct(F.lit(k).alias("band"), F.xxhash64(F.slice("sig", k * size + 1, size)).alias("hash")) for k in range(BANDS)))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """Each row's id and the least id of its class; near-duplicates of near-duplicates are in one class.

    With ``title``, near-duplicates must have titles alike by ``TITLES`` too, in lower case, null as empty.
    """
    rows, distinct = _nodes(docs, key, text, title)
    banded = distinct.select("node", F.explode(_bands()).alias("b")).select("node", "b.*")
    shared = banded.groupBy("band", "hash").agg(F.count("*").alias("n")).filter("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE)).drop("n")
    met = banded.join(shared, ["band", "hash"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    met = met.select("band", "hash", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "node").join(distinct.select("node", "sig", "title"), "node")
    order = ["band", "hash", "u", "v"]
    links = met.select(*order, "node", "sig", "title").repartition(*order).sortWithinPartitions(*order).mapInPandas(_spanning, "a long, b long")
    rooted = save(distinct.select("node", "least", "n").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    sizes = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n"))
    named = join_unique(rooted.select("node", "root"), sizes.select("root", "class_id"), "root", sizes.select("root", "n"))
    return join_unique(rows.select("id", F.col("kind").alias("node")), named.select("node", "class_id"), "node", distinct.select("node", "n")).select("id", "class_id")


def near_titled(articles: DataFrame, key: str = "id", title: str = "title", text: str = "content") -> DataFrame:
    """id and class_id by both rules: three-word minima of the contents alike by 0.90, and titles by 0.80."""
    return near_classes(articles, key, text, title)


def _alike_titles(a: Column, b: Column) -> Column:
    @F.pandas_udf("boolean")
    def alike(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([titled_alike(x, y) for x, y in zip(xs, ys, strict=True)], dtype=bool)

    return alike(a, b)


def keep_first(articles: DataFrame, key: str = "id", title: str = "title", text: str = "content") -> DataFrame:
    """id and whether the row is kept, in ascending order of id: a row is kept if no earlier one that is kept is like it by both rules of ``near_titled``.

    The greedy choice in rounds. A row that is the first undecided one in each of its bands can be like no earlier undecided row, so it is kept; those that meet it in a band and are like it
    go. Each round compares a band's rows with one row only. As the first undecided row is always kept, rounds end; they are as many as the longest chain of rows that wait for one
    another. Rows of equal minima and titles are one; of these the least id stands for all, and rows that repeat it share its fate. Ids must not be null.
    """
    rows, distinct = _nodes(articles, key, text, title)
    keys = F.transform(_bands(), lambda b: F.xxhash64(b["band"], b["hash"]))
    open_ = save(distinct.select("node", "least", "sig", "title", keys.alias("keys")), "open")
    kept = []
    while open_.count():
        banded = save(open_.select("node", "least", F.explode("keys").alias("key")), "banded")
        firsts = banded.groupBy("key").agg(F.min(F.struct("least", "node")).alias("first"), F.count("*").alias("n"))
        firsts = save(firsts.select("key", F.col("first.node").alias("first"), "n"), "firsts")
        met = save(join_unique(banded, firsts.select("key", "first"), "key", firsts.select("key", "n")).select("node", "first"), "met")
        now = save(met.groupBy("node").agg(F.min((F.col("node") == F.col("first")).cast("int")).alias("leads")).filter("leads = 1").select("node"), "kept")
        kept.append(now)
        ahead = open_.join(now, "node", "left_semi").select(F.col("node").alias("first"), F.col("sig").alias("first_sig"), F.col("title").alias("first_title"))
        pairs = save(met.filter("node <> first").distinct(), "pairs")
        sized = pairs.groupBy("first").agg(F.count("*").alias("n"))
        pairs = join_unique(pairs, ahead, "first", sized).join(open_.select("node", "sig", "title"), "node")
        agree = F.size(F.filter(F.zip_with("sig", "first_sig", lambda a, b: a == b), lambda x: x)) >= AGREE
        gone = pairs.filter(agree).filter(_alike_titles(F.col("title"), F.col("first_title"))).select("node")
        left = save(open_.join(gone.union(now), "node", "left_anti"), "open")
        for table in (open_, banded, firsts, met):
            discard(table)
        open_ = left
    if not kept:
        return rows.select("id", F.lit(True).alias("kept"))
    stay = functools.reduce(DataFrame.union, kept)
    first = distinct.join(stay.withColumn("_stays", F.lit(True)), "node", "left").select("node", "least", F.coalesce("_stays", F.lit(False)).alias("stays"))
    told = join_unique(rows.select("id", F.col("kind").alias("node")), first, "node", distinct.select("node", "n"))
    return told.select("id", (F.col("stays") & (F.col("id") == F.col("least"))).alias("kept"))
