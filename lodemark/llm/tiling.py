"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

1. Seeds: the windows of ``least`` tokens of each benchmark item, as rolling hashes. A fixed-size bitmap of them lets one pass over
   the documents keep what can match: the tokens of windows that the benchmark has too.
2. Join on shared seeds. An item that is covered to ``coverage`` can't miss more than the rest of its tokens, so every document that covers it
   has a window that touches one of any few more. Those of an item's tokens whose windows the fewest items share are taken; their windows
   join documents and items. A line that many items share so makes no pairs, unless it is nearly all there is of them.
3. Tiling of each pair: seeds, verified on the tokens, grow to maximal matches; the longest that overlaps no tile becomes the next tile, until none
   of ``least`` tokens is left. The share of the item under tiles is its coverage, in whatever order its passages come.

Items with the same tokens are tiled once. Items of fewer than ``least`` tokens have one window, the whole item.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.batches import bound_bytes
from lodemark.storage import save

from .common import light, read_table, slices

LEAST, COVERAGE = 5, 0.8
#: Bits of the bitmap for each window of the benchmark, the fewest and the most of all (512 KB, 128 MB), and bits that each window sets.
BITS, LEAST_BITS, MOST_BITS, PROBES = 64, 1 << 22, 1 << 30, 3
#: Pairs of equal windows that are looked at together.
SLAB = 2_000_000
#: Scripts without spaces between words (Thai to Khmer, Chinese, Japanese): each character is a token.
UNSPACED = "฀-໿က-႟ក-៿⺀-⿟぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
PLAIN, ANY_UNSPACED, MIXED = re.compile(r"\w+"), re.compile(f"[{UNSPACED}]"), re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]")
BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Lower-case words without punctuation, and single characters of scripts without spaces."""
    low = (text or "").lower()
    return (PLAIN if low.isascii() or not ANY_UNSPACED.search(low) else MIXED).findall(low)


def numbered(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's tokens as hashes; 0 stands for none of them."""
    named = [tokens(t) for t in texts]
    kinds = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) or 1 for x in named for w in x}
    return [np.fromiter(map(kinds.__getitem__, x), np.uint64, len(x)) for x in named]


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2^64, of each window of ``width`` ids; windows of other widths have other hashes."""
    n = len(ids) - width + 1
    out = np.full(max(0, n), width, np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * BASE + ids[k : k + n]
    return out ^ (out >> np.uint64(32))


def maximal(doc_hashes: np.ndarray, at: np.ndarray, item_hashes: np.ndarray, item_order: np.ndarray) -> np.ndarray:
    """(start in the document, start in the item, windows) of each run of equal windows; ``at``: the document's places that have any, ascending."""
    found = []
    low, high = np.searchsorted(item_hashes, doc_hashes[at]), np.searchsorted(item_hashes, doc_hashes[at], "right")
    n, first = high - low, 0
    through = np.cumsum(n)
    while first < len(at):  # by slabs of the document, so that runs are cut at few places
        last = max(first + 1, int(np.searchsorted(through, (through[first - 1] if first else 0) + SLAB, "right")))
        own, m = n[first:last], int(n[first:last].sum())
        i = np.repeat(at[first:last], own)
        j = item_order[np.repeat(low[first:last] - np.concatenate(([0], np.cumsum(own)[:-1])), own) + np.arange(m)]
        order = np.lexsort((i, i - j))
        i, j = i[order], j[order]
        cut = np.flatnonzero((np.diff(i - j) != 0) | (np.diff(i) != 1)) + 1
        starts = np.concatenate(([0], cut))
        found.append(np.stack((i[starts], j[starts], np.diff(np.append(starts, m))), axis=1))
        first = last
    runs = np.concatenate(found)
    if len(found) > 1:  # runs that go on in the next slab
        runs = runs[np.lexsort((runs[:, 0], runs[:, 0] - runs[:, 1]))]
        goes_on = (np.diff(runs[:, 0] - runs[:, 1]) == 0) & (runs[:-1, 0] + runs[:-1, 2] == runs[1:, 0])
        heads = np.flatnonzero(np.concatenate(([True], ~goes_on)))
        runs = np.column_stack((runs[heads, :2], np.add.reduceat(runs[:, 2], heads)))
    return runs


def greedy_tiles(runs: np.ndarray, n_doc: int, n_item: int, width: int) -> list[tuple[int, int, int]]:
    """Tiles (start in the document, start in the item, length), longest first, ties by position, of maximal matches."""
    heap = [(-(n + width - 1), i, j) for i, j, n in runs.tolist()]
    heapq.heapify(heap)
    in_doc, in_item, tiles = np.zeros(n_doc, bool), np.zeros(n_item, bool), []
    while heap:
        minus, i, j = heapq.heappop(heap)
        taken = in_doc[i : i - minus] | in_item[j : j - minus]
        if not taken.any():
            in_doc[i : i - minus] = in_item[j : j - minus] = True
            tiles.append((i, j, -minus))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([1], taken, [1])).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= width:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


class Tiled:
    """What is left of a document, and its windows by width."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.by_width = ids, {}

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if width not in self.by_width:
            hashes = rolling(self.ids, width)
            order = np.argsort(hashes, kind="stable")
            self.by_width[width] = hashes, order, hashes[order]
        return self.by_width[width]

    def cover(self, item: np.ndarray, least: int, coverage: float) -> tuple[float, int, int, int] | None:
        """(coverage, tokens under tiles, tiles, longest tile), or None below ``coverage``."""
        width, n = min(least, len(item)), len(item)
        hashes, order, ranked = self.windows(width)
        own = rolling(item, width)
        low, high = np.searchsorted(ranked, own), np.searchsorted(ranked, own, "right")
        hit, under = np.flatnonzero(high > low), np.zeros(n, bool)
        hit = hit[[bool((self.ids[order[low[k]] + np.arange(width)] == item[k : k + width]).all()) for k in hit]] if len(hit) else hit
        for k in range(width):
            under[hit + k] = True
        if not len(hit) or under.sum() < coverage * n - 1e-9:
            return None  # not even all its seeds cover enough
        kinds = np.unique(own[hit])
        at = np.sort(np.concatenate([order[a:b] for a, b in zip(np.searchsorted(ranked, kinds), np.searchsorted(ranked, kinds, "right"), strict=True)]))
        places = hit[np.argsort(own[hit], kind="stable")]
        tiles = greedy_tiles(maximal(hashes, at, own[places], places), len(self.ids), n, width)
        got = sum(t[2] for t in tiles)
        return (got / n, got, len(tiles), max(t[2] for t in tiles)) if got >= coverage * n - 1e-9 else None


def _items(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = numbered(batch.column(1).to_pylist())
            keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in ids]
            windows = [rolling(x, min(least, len(x))).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in ids]
            columns = [pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int32()), pa.array(windows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["item_id", "key", "ids", "n", "windows"])

    return run


def _rare_windows(least: int, coverage: float):
    """Of (key, n, windows, shared: in how many items each window is): the windows that every document which covers the item has one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, out = [], []
            for key, n, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                windows.sort(key=lambda w: w["at"])
                shared, width = np.array([w["shared"] for w in windows]), min(least, n)
                worst = np.zeros(n, np.int64)  # of each token, the most shared window it is in
                for k in range(width):
                    worst[k : k + len(shared)] = np.maximum(worst[k : k + len(shared)], shared)
                missed = n - ceil(coverage * n - 1e-9)  # tokens that can stay uncovered
                tokens_ = np.argsort(worst, kind="stable")[: missed + 1]
                touched = np.unique(np.clip(tokens_[:, None] - np.arange(width), 0, len(shared) - 1))
                chosen = {windows[w]["hash"] for w in touched.tolist()}
                keys += [key] * len(chosen)
                out += sorted(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.int64())], names=["key", "hash"])

    return run


def _suspects(bitmap, mask: int, widths: list[int]):
    """Of (doc_id, text): row, doc_id, digest of the text, its tokens that seeds cover (0 for what is between), and the seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, row = np.frombuffer(bitmap.value, np.uint8), TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            rows = []
            for doc, text, ids in zip(batch.column(0).to_pylist(), texts := batch.column(1).to_pylist(), numbered(texts), strict=True):
                row += 1
                covered, seeds = np.zeros(len(ids), bool), []
                for width in widths:
                    hashes = rolling(ids, width)
                    at = np.arange(len(hashes))
                    for probe in range(PROBES):
                        place = (hashes[at] >> np.uint64(10 * probe)) & np.uint64(mask)
                        at = at[((bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                    if len(at):
                        seeds.append(hashes[at])
                        for k in range(width):
                            covered[at + k] = True
                if seeds:
                    ids[~covered] = 0
                    kept = covered | np.concatenate(([False], covered[:-1]))  # one 0 after each run
                    rows.append((row, doc, hashlib.md5(text.encode("utf-8", "replace")).hexdigest(), ids[kept].tobytes(), np.unique(np.concatenate(seeds)).view(np.int64)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["row", "doc_id", "digest", "ids", "seeds"])

    return run


def _tile(least: int, coverage: float):
    """Over rows sorted by row and kind, a document (kind 0) and then its items, one after another: those that it covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, doc = None, None
        for batch in slices(batches):
            out = []
            for row, kind, doc_id, digest, key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    at, doc = (row, doc_id, digest), Tiled(np.frombuffer(ids, np.uint64))
                elif found := doc.cover(np.frombuffer(ids, np.uint64), least, coverage):
                    out.append((*at[1:], key, *found))
            types = [pa.int64(), pa.string(), pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "digest", "key", "coverage", "tokens", "tiles", "longest"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, least: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, key, coverage, tokens, tiles, longest) of documents and items, and (item_id, key) of the items."""
    spark = docs.sparkSession
    bound_bytes(spark)
    raw = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    named = save(raw.mapInArrow(_items(least), "item_id long, key binary, ids binary, n int, windows array<long>").filter("n > 0"), "items")
    items = save(named.dropDuplicates(["key"]).select("key", "ids", "n", "windows"), "kinds")
    windows = items.select("key", "n", F.posexplode("windows").alias("at", "hash"))
    shared = windows.groupBy("hash").agg(F.count_distinct("key").alias("shared"))
    ranked = windows.join(shared, "hash").groupBy("key", "n").agg(F.collect_list(F.struct("at", "hash", "shared")).alias("windows"))  # as long as an item
    seeds = save(ranked.mapInArrow(_rare_windows(least, coverage), "key binary, hash long"), "seeds")
    total, widths = items.agg(F.sum(F.size("windows")), F.array_sort(F.collect_set(F.least("n", F.lit(least))))).first()  # as many widths as ``least`` at most
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * (total or 0)).bit_length()))
    probes = F.explode(F.array(*(F.shiftrightunsigned("hash", 10 * k) for k in range(PROBES))))
    place = F.col("at").bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    parts = windows.select(probes.alias("at")).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # 4 KB for each 32,768 bits
    bitmap = bytearray(bits // 8)
    for p in parts:
        bitmap[(p["bucket"] - 1) * 4096 : p["bucket"] * 4096] = p["bits"]
    bitmap = spark.sparkContext.broadcast(bytes(bitmap))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    suspects = save(rows.mapInArrow(_suspects(bitmap, bits - 1, list(widths)), "row long, doc_id long, digest string, ids binary, seeds array<long>"), "suspects")
    bitmap.destroy()
    met = suspects.select("row", F.explode("seeds").alias("hash")).join(light(seeds), "hash").select("row", "key").distinct()
    asked = met.join(items.select("key", "ids"), "key").select("row", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("digest"), "key", "ids")
    held = suspects.join(met.select("row").distinct(), "row", "left_semi").select("row", F.lit(0).alias("kind"), "doc_id", "digest", F.lit(None).cast("binary").alias("key"), "ids")
    dealt = held.unionByName(asked).repartition("row").sortWithinPartitions("row", "kind")
    return save(dealt.mapInArrow(_tile(least, coverage), "doc_id long, digest string, key binary, coverage double, tokens long, tiles long, longest long"), "matches"), named.select("item_id", "key")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, tokens, tiles, longest) for each document that covers ``coverage`` of an item or more.

    Null and empty texts, and texts without tokens, match nothing. Items of fewer than ``least`` tokens must be covered as a whole. Rows and items that
    repeat are each in the result, and equal texts have equal results; ties between equally long tiles go to the first place. Texts of any length are
    read whole. Null ids stay null. Columns other than those named aren't read, whatever their names. An empty table on either side gives no rows.
    """
    found, named = matches(docs, benchmark, key, text, item, item_text, least, coverage)
    return found.join(light(named), "key").select("doc_id", "item_id", "coverage", "tokens", "tiles", "longest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text covers no item.

    Null, empty and repeated texts, very long ones, ties and empty tables are as in ``contaminated``: rows without a match stay, as often as they
    are there. Ids aren't looked at, and no column's name can clash.
    """
    found, _ = matches(docs.select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text")), benchmark, "id", "text", item, item_text, least, coverage)
    bad = save(found.select(F.col("digest").alias("_leaked_digest")).distinct(), "leaks")
    return docs.join(light(bad), F.md5(docs[text]) == bad["_leaked_digest"], "left_anti")


def op10_decontaminate(spark, sf_dir):
    return contaminated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
