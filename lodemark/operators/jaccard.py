"""Near-duplicate texts: Jaccard similarity of five-word shingles, verified on the shingles themselves.

A sketch stands for a set of shingles and tells which sets may be alike. In ``MINHASH`` it is 150 minima, a byte of each: two sets of
similarity 0.8 have five equal minima in one of 30 bands with probability 1 - 7e-6, and fewer than 96 equal ones with 2e-6. Nodes that meet
in a band and agree in 96 minima are linked. (``llm.simhash`` has a sketch of fingerprints.) Equal sets are one node, and what the links of
a sketch connect is a cluster. Texts go once to the tasks of their cluster, where each link is verified on whole
sets of shingles. Within bands and clusters no list of pairs is made: a task walks a group breadth-first and emits links that span it.
Large groups are cut into tiles, each two of which meet in a task of their own. In a large cluster all texts meet a few heads first: those
that are like one head are linked by it and needn't meet each other, so a cluster of near copies of one text ships each text a few times
whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.batches import bound_bytes
from lodemark.storage import save

from .graph import components
from .skew import join_unique, light

WORDS, LEAST, MINIMA, BAND, ALIKE = 5, 0.8, 150, 5, 96
#: Members of a group that meet in one task, and bytes of their texts.
TILE, TILE_BYTES = 1024, 32 << 20
#: Heads that the members of a large cluster meet, one after another, before those that are like none of them meet in tiles.
HEADS = 3
_RNG = np.random.default_rng(150)
#: Which of some sketches (rows of a matrix) are near to one.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]
_A, _B = _RNG.integers(1, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1), _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, in lower case; a text of fewer words is one shingle."""
    w = (text or "").lower().encode("utf-8", "replace").split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - words + 1)
    out = np.full(n, min(len(w), words), np.uint64)
    for k in range(min(len(w), words)):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The lowest byte of each of 150 minima."""
    out = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 1024):
        mixed = short[k : k + 1024, None] * _A + _B
        out = np.minimum(out, (mixed ^ (mixed >> np.uint32(15))).min(0))
    return out.astype(np.uint8)


def same_minima(sigs: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Which of ``sigs`` agree with ``sig`` in 96 minima."""
    return (sigs == sig).sum(1) >= ALIKE


def _sets(sign: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sigs = [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sigs.append(sign(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), batch.column(3)], names=["id", "text_hash", "node", "sig", "size"])

    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= LEAST


def spanning(nodes: np.ndarray, sigs: np.ndarray, alike: Callable[[int, np.ndarray], np.ndarray] | None = None, near: Near = same_minima) -> list[tuple[int, int]]:
    """Links that span each part of a group: of members whose sketches are near, where ``alike`` (a place, places) agrees as well."""
    left, out = np.arange(len(nodes)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            found = near(sigs[left], sigs[at])
            if alike and found.any():
                found[found] = alike(at, left[found])
            if found.any():
                out += [(nodes[at], nodes[x]) for x in left[found]]
                queue += left[found].tolist()
                left = left[~found]
    return out


def _walk(verify: bool, near: Near):
    """Over rows of group, u, v, node, sig and (to verify) text, sorted by the first three: links that span each group."""

    def links(held: list[tuple]) -> list[tuple[int, int]]:
        members = {h[0]: h for h in held}
        if len(members) < 2:
            return []
        nodes = np.fromiter(members, np.int64, len(members))
        sigs = np.frombuffer(b"".join(h[1] for h in members.values()), np.uint8).reshape(len(members), -1)
        sets = [h[2] for h in members.values()]

        def alike(at: int, others: np.ndarray) -> np.ndarray:
            return np.array([similar(sets[at], sets[x]) for x in others])

        return spanning(nodes, sigs, alike if verify else None, near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            out, columns = [], [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:3] != last:
                    out += links(held)
                    held, last = [], row[:3]
                held.append((row[3], row[4], shingles(row[5]) if verify else None))
            yield _batch(out)
        yield _batch(links(held))

    return run


def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _tiled(members: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Each member in each two tiles of its group that hold it; ``groups`` has the number of tiles."""
    met = members.join(groups, key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return met.withColumns({"u": F.least("own", "other"), "v": F.greatest("own", "other")})


def _met(tiled: DataFrame, key: str, *more: str, verify: bool, near: Near = same_minima) -> DataFrame:
    order = [key, "u", "v"]
    return tiled.select(*order, "node", "sig", *more).repartition(*order).sortWithinPartitions(*order).mapInArrow(_walk(verify, near), "a long, b long").distinct()


def _band_links(distinct: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    bands = F.explode(F.array(*(F.xxhash64(F.lit(k), F.substring("sig", k * BAND + 1, BAND)) for k in range(MINIMA // BAND))))
    keys = distinct.select("node", bands.alias("band"))
    shared = keys.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile))
    met = _met(_tiled(keys, shared, "band").join(distinct.select("node", "sig"), "node"), "band", verify=False)
    return met, keys.join(shared, "band").groupBy("node").agg(F.sum("n").alias("weight"))


class Sketch(NamedTuple):
    """What stands for a set of shingles, which sketches are near, and how those that are find each other.

    ``links`` takes a table of node and sig and a tile's members; it returns links (a, b) that connect all near nodes, and node and
    weight, larger for nodes that are near to many.
    """

    sign: Callable[[np.ndarray], np.ndarray]
    near: Near
    links: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]]


MINHASH = Sketch(signature, same_minima, _band_links)


MEMBER = "node long, root long, text_hash long, size long, sig binary, weight long, text string, head long"


def _star(near: Near):
    """Over rows of part and ``MEMBER``, where a part's first row is its head: the other rows, with the head's node and no text where they are like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, lead_sig, lead_set = None, None, None
        for batch in batches:
            columns = {f.name: c for f, c in zip(batch.schema, batch.columns, strict=True)}
            is_head, node, sigs, text = (columns[c].to_pylist() for c in ("is_head", "node", "sig", "text"))
            keep, nodes, texts = [], [], []
            for k, first in enumerate(is_head):
                sig = np.frombuffer(sigs[k], np.uint8)
                if first:
                    lead, lead_sig, lead_set = node[k], sig, shingles(text[k])
                    continue
                found = near(sig[None], lead_sig)[0] and similar(lead_set, shingles(text[k]))
                keep.append(k)
                nodes.append(lead if found else None)
                texts.append(None if found else text[k])
            same = [columns[c].take(pa.array(keep, pa.int64())) for c in ("node", "root", "text_hash", "size", "sig", "weight")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(texts, pa.string()), pa.array(nodes, pa.int64())], names=[f.split()[0] for f in MEMBER.split(", ")])

    return run


def _tiles(tile: int):
    return F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") / TILE_BYTES))


def _headed(members: DataFrame, tile: int, near: Near) -> tuple[DataFrame, DataFrame]:
    """(node, root, text_hash, size, sig, cls) of ``members`` (of large clusters, as ``MEMBER`` without head), and links (a, b) to heads.

    In each of a few rounds the member of the largest weight heads those that are left of its cluster. cls is the round in which a
    member was found to be like its head, and 0 if it is like none. A head goes to each part of its cluster; a member is in one part.
    """
    left, found = save(members, "members"), []
    for k in range(1, HEADS + 1):
        heads = left.groupBy("root").agg(F.max_by("node", F.struct("weight", "node")).alias("chief"), _tiles(tile).alias("parts"))
        heads = light(save(heads, "heads"))
        asked = left.join(heads, "root")
        rows = asked.withColumns({"part": F.pmod(F.xxhash64("node"), F.col("parts")), "is_head": F.lit(False)})
        chiefs = asked.filter("node = chief").withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "is_head": F.lit(True)})
        dealt = rows.unionByName(chiefs).select("root", "part", "is_head", "node", "text_hash", "size", "sig", "weight", "text")
        met = save(dealt.repartition("root", "part").sortWithinPartitions("root", "part", F.desc("is_head")).mapInArrow(_star(near), MEMBER), "met")
        found.append(met.filter("head IS NOT NULL").withColumn("cls", F.lit(k)))
        left = met.filter("head IS NULL").drop("head")
        if left.isEmpty():
            break
    links = reduce(DataFrame.unionByName, found).filter("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b"))
    same = ["node", "root", "text_hash", "size", "sig", "cls"]
    return reduce(DataFrame.unionByName, (f.select(same) for f in (*found, left.withColumn("cls", F.lit(0))))), links


def _crossed(members: DataFrame, tile: int) -> DataFrame:
    """Each member in each two tiles of its cluster that hold it and can bring a new link: those of one class are linked by their head already."""
    sized = members.groupBy("root", "cls").agg(_tiles(tile).alias("tiles")).groupBy("root").agg(F.collect_list(F.struct("cls", "tiles")).alias("classes"))
    met = members.join(sized, "root").withColumn("tiles", F.filter("classes", lambda c: c["cls"] == F.col("cls"))[0]["tiles"])
    met = met.withColumn("c", F.explode(F.filter("classes", lambda c: (F.col("cls") == 0) | (c["cls"] != F.col("cls")))))
    met = met.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c.tiles") - 1)))
    own = F.shiftleft(F.col("cls").cast("long"), 32) + F.pmod(F.xxhash64("node"), F.col("tiles"))
    other = F.shiftleft(F.col("c.cls").cast("long"), 32) + F.col("at")
    return met.select("root", "node", "sig", "text_hash", F.least(own, other).alias("u"), F.greatest(own, other).alias("v"))


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", tile: int = TILE, sketch: Sketch = MINHASH) -> DataFrame:
    """id, text_hash and class_id (the least id of the class) for each row of ``docs``.

    Texts of similarity 0.8 or more are in one class, and so are those that such links connect. Null texts count as empty, and all texts
    without words are alike. Rows without an id never name a class; its id is null if no row has one. ``text_hash`` is Spark's
    xxhash64 of the text, with null as empty.
    """
    bound_bytes(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"), F.octet_length(whole).cast("long").alias("size"))
    rows = save(plain.mapInArrow(_sets(sketch.sign), "id long, text_hash long, node long, sig binary, size long"), "sets")
    distinct = save(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min("text_hash").alias("text_hash"), F.max("size").alias("size"), F.min("sig").alias("sig")), "distinct")
    met, weights = sketch.links(distinct.select("node", "sig"), tile)
    clusters = save(components(met).join(distinct.select("node", "text_hash", "size", "sig"), "node"), "clusters")
    sized = clusters.groupBy("root").agg(_tiles(tile).alias("tiles"))
    large = light(save(sized.filter("tiles > 1").select("root"), "large"))

    def with_texts(some: DataFrame) -> DataFrame:
        wanted = light(save(some.select("text_hash").distinct(), "wanted"))
        texts = plain.select("text_hash", "text").join(wanted, "text_hash").groupBy("text_hash").agg(F.any_value("text").alias("text"))
        return some.join(texts, "text_hash")

    members, links = clusters.withColumn("cls", F.lit(0)), None
    if not large.isEmpty():
        many = clusters.join(large, "root")
        of_large, links = _headed(with_texts(many.join(weights, "node")), tile, sketch.near)
        members = members.join(large, "root", "left_anti").unionByName(of_large)
    crossed = save(_crossed(members, tile), "crossed")
    other = {} if sketch is MINHASH else {"near": sketch.near}
    verified = _met(with_texts(crossed), "root", "text", verify=True, **other)
    links = verified.unionByName(links) if links is not None else verified
    roots = components(links).withColumnRenamed("root", "head")
    headed = save(distinct.select("node", "least").join(roots, "node", "left"), "headed")
    linked = headed.filter("head IS NOT NULL")
    sizes = linked.groupBy("head").agg(F.min("least").alias("class_id"), F.count("*").alias("n"))
    linked = join_unique(linked, sizes.select("head", "class_id"), "head", sizes.select("head", "n")).select("node", "class_id")
    named = save(linked.unionByName(headed.filter("head IS NULL").select("node", F.col("least").alias("class_id"))), "classes")
    return join_unique(rows.select("id", "text_hash", "node"), named, "node", distinct.select("node", "n")).select("id", "text_hash", "class_id")
