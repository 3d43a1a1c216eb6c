"""SimHash near-dedup: pigeonhole blocks, a join on blocks, then verified Hamming distances.

Fingerprints of 64 bits are cut into m blocks. Two that differ in at most d bits agree in m - d blocks at least, so each
choice of m - d blocks is a key, and all close pairs share a key. m grows with the number of fingerprints so that keys stay
selective. Only distinct fingerprints meet: copies are counted once. Within a key no list of pairs is made: a task walks the
group breadth-first and emits links that span it (one less than its members at most). Keys with many members are cut into tiles,
and each two tiles of a key meet in a task of their own.

``keep_one`` looks for near copies (five-word Jaccard of 0.8 or more) that 64 bits can't tell from others: its fingerprints have 512 bits,
of which a pair at 0.8 differs in 0.15 to 0.16 by expectation (0.19 where four shingles are a text's and four of another's five). Blocks that all
such pairs share don't exist, so its keys are drawn bits, as many as make a pair agree in one key with probability 1 - 1e-5; sets of five or less
have more keys. Members of a key are compared on 192 bits, pairs found on all 512, and what that connects is verified on shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb, exp, lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.batches import bound_bytes
from lodemark.operators.graph import components
from lodemark.operators.jaccard import Sketch, jaccard_classes, spanning as spanning_near
from lodemark.operators.skew import join_unique, light
from lodemark.storage import save

from .common import fresh, read_table, slices

SHINGLE, SEED, DISTANCE, TILE = 4, 42, 4, 4096
#: Wide fingerprints: their bits, those that go along with each key, and how many may differ among all and among these.
WIDE, SHOWN, NEAR, NEAR_SHOWN = 512, 192, 136, 62
#: Share of the bits in which sets of similarity 0.8 differ (the most for any sizes; and for those of ``FEW`` or less), and how many such pairs may share no key.
APART, APART_FEW, FEW, MISSED = 0.1612, 0.1875, 5, 1e-5
_ODD = np.random.default_rng(512).integers(1, 2**63, WIDE // 64, dtype=np.uint64) | np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned. Lower-cases A-Z; words are runs of anything but ASCII white space (as bytes.split has it)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[k : k + 65536], stops[k : k + 65536], strict=True)), np.dtype(">u8"))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long); null and empty texts have 0."""
    bound_bytes(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def block_masks(n: int, distance: int = DISTANCE) -> list[int]:
    """Signed masks of the keys for n distinct fingerprints: the number of blocks with the least work.

    A key is a row to shuffle, another visit if it has a chance partner, and a comparison (which costs a thousandth) with each partner.
    More blocks make more keys, but longer ones.
    """

    def work(m: int) -> float:
        partners = n / 2 ** (64 * (m - distance) / m)
        return comb(m, distance) * (1.5 + 2 * min(1.0, partners) + partners / 1000)

    m = min(range(distance + 1, 13), key=work)
    edges = [round(64 * k / m) for k in range(m + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(blocks, m - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of at most ``distance`` bits that span each part of a group: breadth-first, each member is reached once."""
    left, out = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                out += [(int(at), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return out


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(fps)]))
            two = starts[ends - starts == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance
            a, b = [fps[two][near]], [fps[two + 1][near]]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                found = np.array(spanning(np.unique(fps[s:e]), distance), np.uint64).reshape(-1, 2)
                a.append(found[:, 0])
                b.append(found[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

        held: list[np.ndarray] = []  # the last group so far, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            rows = np.concatenate([*held, rows])
            keys = rows[:, :4]
            last = int(np.argmax(np.all(keys == keys[-1], axis=1)))
            if last:
                yield links(keys[:last], np.ascontiguousarray(rows[:last, 4]).view(np.uint64))
            held = [rows[last:]]
        if held:
            yield links(held[0][:, :4], np.ascontiguousarray(held[0][:, 4]).view(np.uint64))

    return run


def close_links(distinct: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all that differ in ``distance`` bits or fewer."""
    masks = block_masks(distinct.count(), distance)
    keyed = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("block"), F.col("fp").bitwiseAND(F.lit(x).cast("long")).alias("key")) for k, x in enumerate(masks))))
    keys = distinct.select("fp", keyed.alias("k")).select("fp", "k.block", "k.key")
    shared = keys.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keys.join(shared, ["block", "key"]).withColumn("tiles", F.ceil(F.col("n") / tile))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    order = ["block", "key", "u", "v"]
    met = met.select("block", "key", F.least("own", "other").cast("long").alias("u"), F.greatest("own", "other").cast("long").alias("v"), "fp")
    return met.repartition(*order).sortWithinPartitions(*order).mapInArrow(_links(distance), "a long, b long").distinct()


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id that links reach) for each row of ``docs``.

    Null texts count as empty; all texts without words have fingerprint zero and are linked like any others. Rows that
    repeat a doc_id are in the result as often. Rows without a doc_id are linked, but never name a component: its id is
    null only if none of its rows has one. Empty tables give no rows.
    """
    rows = save(fingerprints(docs, key, text), "fingerprints")
    distinct = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(close_links(distinct.select("fp"), distance))
    named = save(distinct.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left"), "rooted")
    linked = named.filter("root IS NOT NULL")
    sizes = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    linked = join_unique(linked, sizes.select("root", "component_id"), "root", sizes.select("root", "n")).select("fp", "component_id")
    named = save(linked.unionByName(named.filter("root IS NULL").select("fp", F.col("least").alias("component_id"))), "components")
    joined = join_unique(rows, named, "fp", distinct.select("fp", "n"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """512 bits (64 bytes) of a set of hashes: each is 1 if set in over half of them, as in ``fingerprint``. A byte more is 1 if they are few."""
    counts = np.zeros(WIDE, np.int64)
    for k in range(0, len(hashes), 255):
        mixed = hashes[k : k + 255, None] * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.append(np.packbits(counts * 2 > len(hashes)), np.uint8(len(hashes) <= FEW))


def within(sigs: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Which wide fingerprints (rows of bytes) differ from one in 136 bits or fewer."""
    return np.bitwise_count(sigs[..., : WIDE // 8] ^ sig[..., : WIDE // 8]).sum(-1, dtype=np.int64) <= NEAR


def _within_shown(words: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words ^ one).sum(1, dtype=np.int64) <= NEAR_SHOWN


@cache
def keys_needed(bits: int, apart: float = APART) -> int:
    """Keys of ``bits`` drawn bits until a pair whose bits differ with the odds ``apart`` agrees in one, but for ``MISSED``."""
    d = np.arange(WIDE + 1)
    odds = np.array([exp(lgamma(WIDE + 1) - lgamma(x + 1) - lgamma(WIDE - x + 1) + x * log(apart) + (WIDE - x) * log(1 - apart)) for x in d])
    agree = np.prod([np.maximum(WIDE - d - j, 0) / (WIDE - j) for j in range(bits)], axis=0)
    low, high = 0, 1
    while (odds * (1 - agree) ** high).sum() > MISSED:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if (odds * (1 - agree) ** middle).sum() > MISSED else (low, middle)
    return high


def drawn_keys(n: int) -> tuple[np.ndarray, int]:
    """The bits of each key for n fingerprints, and how many of these keys sets have that aren't small.

    The number of bits is that of the least work: a key is a row to shuffle, which costs as much as some hundred comparisons.
    """
    bits = min(range(4, 25), key=lambda k: keys_needed(k) * (1 + n / 2**k / 750))
    rng = np.random.default_rng(bits)
    return np.stack([rng.permutation(WIDE)[:bits] for _ in range(keys_needed(bits, APART_FEW))]), keys_needed(bits)


def _keyed(places: np.ndarray, most: int, shown: bool):
    """Over node and sig: a row for each key with its group (number and bits in one long) and, if ``shown``, node and 192 bits."""

    def keys(nodes: np.ndarray, sigs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        m, bits = places.shape
        single = np.unpackbits(sigs, axis=1)
        groups = (np.arange(m, dtype=np.int64) << bits) + sum(single[:, places[:, j]].astype(np.int64) << j for j in range(bits))
        columns = {"group": groups.ravel()}
        if shown:
            words = np.ascontiguousarray(sigs[:, : SHOWN // 8]).view(np.int64)
            columns |= {"node": np.repeat(nodes, m), **{f"w{j}": np.repeat(words[:, j], m) for j in range(SHOWN // 64)}}
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, sigs = batch.column(0).to_numpy(), _rows(batch.column(1))
            few = sigs[:, -1] == 1
            yield keys(nodes[~few], sigs[~few], places[:most])
            yield keys(nodes[few], sigs[few], places)

    return run


def _rows(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(-1, WIDE // 8 + 1)


def _near_pairs(nodes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, bool]:
    """All pairs of a group that are near on the bits shown; where these are many, links that span them, and True."""
    order = np.argsort(nodes)  # so that groups of the same members have the same links
    nodes, words = nodes[order], words[order]
    m, found, n = len(nodes), [np.zeros((0, 2), np.int64)], 0
    step = max(1, (1 << 18) // m)
    for k in range(0, m, step):
        apart = sum(np.bitwise_count(words[k : k + step, None, j] ^ words[None, :, j]) for j in range(words.shape[1]))
        a, b = np.nonzero(apart <= NEAR_SHOWN)
        a, b = a[b > a + k] + k, b[b > a + k]
        found.append(np.stack([nodes[a], nodes[b]], axis=1))
        n += len(a)
        if n > 2 * m:
            return np.array(spanning_near(nodes, words, near=_within_shown), np.int64).reshape(-1, 2), True
    return np.concatenate(found), False


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows of group, u, v, node and the bits shown, sorted by the first three: a, b, and whether the link is needed as it is."""

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(rows)]))
        several = ends - starts > 1
        for s, e in zip(starts[several], ends[several], strict=True):
            found, spans = _near_pairs(rows[s:e, 3], np.ascontiguousarray(rows[s:e, 4:]).view(np.uint64))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.full(len(found), spans))], names=["a", "b", "spans"])

    held: list[np.ndarray] = []  # the last group so far, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
        if np.array_equal(held[0][0, :3], held[-1][-1, :3]):
            continue
        rows = np.concatenate(held)
        last = int(np.argmax(np.all(rows[:, :3] == rows[-1, :3], axis=1)))
        yield from links(rows[:last])
        held = [rows[last:]]
    if held:
        yield from links(np.concatenate(held))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.select([0, 1]).filter(pa.array(within(_rows(batch.column(2)), _rows(batch.column(3)))))


def wide_links(distinct: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(a, b) that connect all nodes of ``distinct`` (node, sig: wide fingerprints) within 136 bits that share a key, and node, weight: its links.

    Groups with more than ``tile`` members are cut, and each two of their tiles meet. All pairs of a group are found, but where they are many: there
    links on the bits shown stay unchecked, as the group holds together by them.
    """
    places, most = drawn_keys(distinct.count())
    order = ["group", "u", "v"]
    groups = distinct.mapInArrow(_keyed(places, most, False), "group long").groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
    large = light(save(groups.select("group", F.ceil(F.col("n") / tile).alias("tiles")), "large"))
    words = [f"w{j}" for j in range(SHOWN // 64)]
    keys = distinct.mapInArrow(_keyed(places, most, True), ", ".join(f"{c} long" for c in ("group", "node", *words)))
    tiles = F.coalesce("tiles", F.lit(1).cast("long"))
    met = keys.join(large, "group", "left").withColumn("own", F.pmod(F.xxhash64("node"), tiles))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    met = met.select("group", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "node", *words)
    met = save(met.repartition(*order).sortWithinPartitions(*order).mapInArrow(_met, "a long, b long, spans boolean").distinct(), "met")
    one, other = (distinct.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    checked = met.filter("NOT spans").select("a", "b").join(one, "a").join(other, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_check, "a long, b long")
    links = save(checked.unionByName(met.filter("spans").select("a", "b")), "near")
    ends = links.select(F.explode(F.array("a", "b")).alias("node"))
    return links, ends.groupBy("node").agg(F.count("*").alias("weight"))


#: Fingerprints in place of minima, for ``jaccard_classes``.
FINGERPRINTS = Sketch(wide_fingerprint, within, wide_links)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest id of each class of near-duplicates, once, with all its columns.

    Documents whose wide fingerprints are near are candidates; those with a five-word Jaccard of 0.8 or more, and what such links connect, are
    near-duplicates. op3's contract of four-word fingerprints binds that query only. Rows without an id stay where nothing with an id is linked to them. Of rows that
    repeat an id that stays, the one with the least hash of its text does. Null texts count as empty, all texts without words are alike, and texts of any length count
    whole. No column's name can clash. Empty tables give no rows.
    """
    classes = save(jaccard_classes(docs, key, text, sketch=FINGERPRINTS), "classes")
    own, hash_ = fresh(docs, "own"), fresh(docs, "hash")
    heads = classes.filter("id = class_id").groupBy(F.col("id").alias(own)).agg(F.count("*").alias("n"))
    heads = save(heads, "heads")
    named = docs.withColumn(own, F.col(key).cast("long"))
    once = named.join(light(heads.filter("n = 1").select(own)), own, "left_semi")
    again = named.join(light(heads.filter("n > 1").select(own)), own, "left_semi").groupBy(own)
    again = again.agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(text)).alias("row")).select("row.*")
    unnamed = light(classes.filter("class_id IS NULL").select(F.col("text_hash").alias(hash_)).distinct())
    others = docs.filter(F.col(key).isNull()).withColumn(hash_, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).join(unnamed, hash_, "left_semi")
    return once.drop(own).unionByName(again).unionByName(others.drop(hash_))


def op3_simhash(spark, sf_dir):
    return near_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
