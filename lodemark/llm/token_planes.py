"""Token ids in byte or bit planes: blocks of ids are transposed into planes, each plane compressed with zstandard.

The file format is a Parquet table of extents, written by Spark's committer (so a lost executor leaves no half-written
files), one row for each: whole documents of at least ``extent_ids`` ids together, cut to blocks of ``block_ids`` ids (the last block of an
extent is shorter). A row holds each block's compressed planes, its ids and its CRC (the chunk index), and the ids and
lengths of its documents. Any extent can be read without the others; shards and extents are in ascending doc_id order.
"""

from __future__ import annotations

import functools
import os
import re
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.batches import bound_bytes
from lodemark.storage import save

from .common import read_table, slices

EXTENT = (
    "shard int, extent int, first_id long, n_ids long, doc_ids array<long>, doc_lengths array<int>, "
    "block_lengths array<int>, block_planes array<int>, block_crcs array<long>, planes array<binary>"
)
#: Cuts that no pre-token of the byte-level pattern crosses: before a space, unless it stands inside of a run of white space.
CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")
#: In texts without these, single newlines, and full stops and commas at the ends of words, stand alone as well.
KNOTTY = re.compile(r"\s\s"), re.compile(r"[.,](?<=[\W_][.,])")
#: Words in each of two generations of the cache of encoded words, and the longest word kept.
CACHE, LONGEST = 400_000, 32
#: Seconds after a worker's last task of an encoder until its words are forgotten, so that idle workers don't hold them through other stages.
IDLE = 3.0


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first, without the zero planes above the highest id."""
    high = int(ids.max()) if len(ids) else 0
    if kind == "byte":
        view = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(view[:, k]).tobytes() for k in range(max(1, (high.bit_length() + 7) // 8))]
    return [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(max(1, high.bit_length()))]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        if kind == "byte":
            out |= np.frombuffer(plane, np.uint8).astype(np.uint32) << np.uint32(8 * k)
        else:
            out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


class Encoder:
    """Ids of whole texts from the tokenizers library, with each distinct word encoded once while it is in the cache.

    The words of a batch that aren't known are encoded in one call, between end marks, which the library never joins to
    their neighbours. Texts that hold the mark are encoded whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        self.cache, self.idle = cache, None
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.mark = next((t.content for t in self.library.get_added_tokens_decoder().values() if t.special), None)
        self.mark_id = self.library.token_to_id(self.mark) if self.mark else None
        rule = self.library.pre_tokenizer.__getstate__() if self.library.pre_tokenizer else b""
        self.cuts = self.mark is not None and self.library.normalizer is None and all(x in rule for x in (b'"ByteLevel"', b'"use_regex":true', b'"add_prefix_space":false'))
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def words(self, text: str) -> list[str]:
        if "\0" in text or any(rule.search(text) for rule in KNOTTY):
            return CUT.split(text)
        return (text + "\0").replace("\n", "\0\n\0").replace(" ", "\0 ").replace(".\0", "\0.\0").replace(",\0", "\0,\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.cuts:
            return self.plain(texts)
        parts = [None if self.mark in t else self.words(t) for t in texts]
        new, old = self.new, self.old
        missing = set().union(*(p for p in parts if p is not None)).difference(new)
        if missing:
            again = {w for w in missing if w in old}  # intersection() would walk all of the dictionary
            new.update((w, old[w]) for w in again)
            asked = sorted(missing - again)
            lines = [self.mark.join(asked[k : k + 100]) for k in range(0, len(asked), 100)]
            ids = np.asarray([i for e in self.library.encode_batch_fast(lines, add_special_tokens=False) for i in (*e.ids, self.mark_id)][:-1], "<u4")
            ends = np.flatnonzero(ids == self.mark_id)
            whole, edges = ids.tobytes(), [-4, *(ends * 4).tolist(), len(ids) * 4]
            new.update(zip(asked, (whole[a + 4 : b] for a, b in zip(edges, edges[1:], strict=False)), strict=True))
        out = [self.plain([t])[0] if p is None else b"".join(map(new.__getitem__, p)) for t, p in zip(texts, parts, strict=True)]
        for w in missing:
            if len(w) > LONGEST:
                del new[w]
        if len(new) > self.cache:
            self.old, self.new = new, {"": b""}
        return out

    def forget(self) -> None:
        self.new, self.old = {"": b""}, {}  # a batch that is being encoded goes on with the dictionaries it has

    def __enter__(self) -> Encoder:
        if self.idle:
            self.idle.cancel()
        return self

    def __exit__(self, *_) -> None:
        self.idle = threading.Timer(IDLE, self.forget)
        self.idle.daemon = True
        self.idle.start()


@functools.cache
def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One for each worker process and path, so that its cache outlives a task; a task uses it in a ``with`` block."""
    return Encoder(path, cache)


def encode_partition(path: str, end_id: int, kind: str, block_ids: int, extent_ids: int, level: int, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pack = encoder(path, cache), zstandard.ZstdCompressor(level=level)
        shard, end = TaskContext.get().partitionId(), np.asarray([end_id], "<u4").tobytes()
        state = {"extent": 0, "first": 0}
        docs: list = []
        lengths: list[int] = []
        held: list[bytes] = []

        def extent() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            blocks = [ids[k : k + block_ids] for k in range(0, len(ids), block_ids)]
            planes = [to_planes(b, kind) for b in blocks]
            row = [shard, state["extent"], state["first"], len(ids), list(docs), list(lengths), [len(b) for b in blocks], [len(p) for p in planes], [zlib.crc32(b.tobytes()) for b in blocks], [pack.compress(x) for p in planes for x in p]]
            state["extent"], state["first"] = state["extent"] + 1, state["first"] + len(ids)
            docs.clear(), lengths.clear(), held.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            names = [x.split()[0] for x in EXTENT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        n = 0
        with coder:
            for batch in slices(batches):
                ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for doc, coded in zip(ids, coder.encode(texts), strict=True):
                    docs.append(doc)
                    lengths.append(len(coded) // 4 + 1)
                    held += [coded, end]
                    n += lengths[-1]
                    if n >= extent_ids:
                        yield extent()
                        n = 0
        if docs:
            yield extent()

    return run


def write_ids(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, kind: str = "byte", block_ids: int = 65536, extent_ids: int = 262144, level: int = 3, cache: int = CACHE) -> DataFrame:
    """Writes the ids of all documents to the shared folder, in ascending id order, and returns the table of extents.

    Null texts are empty and have the end id alone; null doc_ids come first; rows that repeat an id are further documents, in order of a hash of their
    texts. Columns other than key and text aren't read, whatever their names. An empty table writes an empty one. A document isn't cut, so an
    extent is as long as its longest document at least. ``cache``: words in each of two generations of a worker's cache; fewer take less memory and more time.
    """
    bound_bytes(docs.sparkSession)
    order = ["doc_id", "tie"]  # the tie also lets many rows of one id, or of none, go to several tasks
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    extents = ordered.mapInArrow(encode_partition(tokenizer, end_id, kind, block_ids, extent_ids, level, cache), EXTENT)
    return save(extents, "ids", compression="none")


def decode_extents(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                blocks, at = [], 0
                for n, k, crc in zip(row["block_lengths"], row["block_planes"], row["block_crcs"], strict=True):
                    ids = from_planes([unpack.decompress(p) for p in row["planes"][at : at + k]], n, kind)
                    if zlib.crc32(ids.tobytes()) != crc:
                        raise ValueError(f"block of shard {row['shard']}, extent {row['extent']} is damaged")
                    blocks.append(ids)
                    at += k
                whole = memoryview(np.concatenate(blocks).astype("<u4").tobytes())
                ends = np.cumsum(row["doc_lengths"]).tolist()
                starts = [0, *ends[:-1]]
                crcs = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                first, n = row["first_id"], len(ends)
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([first + a for a in starts], pa.int64()), pa.array(row["doc_lengths"], pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"])

    return run


def read_index(extents: DataFrame, kind: str = "byte") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded ids. Shards' sizes alone are summed in one place.

    ``extents``: what ``write_ids`` gives, or its table read again; null and repeated ids and empty texts are in it as further documents, an empty table gives no
    rows. A damaged block raises an error.
    """
    bound_bytes(extents.sparkSession)
    docs = extents.mapInArrow(decode_extents(kind), "doc_id long, shard int, place long, n_tokens long, ids_crc32 long")
    shards = extents.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_token_planes(spark, sf_dir):
    return read_index(write_ids(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json")))
