"""Sum-of-squares online packing of documents into sequences.

Documents are placed as they come. N(h) open windows are filled up to level h; a document goes to the level h that makes the sum of
all N(h)^2 smallest, which keeps the levels varied, so that whatever comes next finds a window that it fills. N is one array of counts, and the windows
of a level are a stack of numbers: what was placed is written at once and never moved. A document that is longer than a window fills
windows of its own first.

Each task packs the documents of its partition, so nothing is shuffled. It keeps a few of the latest documents back, always as many
tokens as its open windows have room for. With these, cut where needed, it fills its windows at the end of its partition; what is left is
cut into full windows and powers of two, which need no padding. If the room in open windows grows beyond a bound, as it
does where no two documents fit into a window, the next documents are cut to fill windows before others are opened. So memory is bounded by
that bound and the longest document.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.batches import bound_bytes

from .common import read_table, slices
from .token_planes import encoder, vocabulary

WINDOW = 1024
#: Tokens that fit into the open windows of a task at most, in windows.
ROOM = 2048
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
TYPES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: A task's sequences are numbered from its partition's number times this on.
STEP = 1 << 40


class Packer:
    """Packs documents as they come. ``pieces`` has what was placed since it was last taken: (doc, start, length, sequence, offset)."""

    def __init__(self, window: int = WINDOW, first: int = 0, room: int = ROOM):
        self.window, self.most, self.next = window, room * window, first
        self.counts = np.zeros(window + 1, np.int64)  # of open windows by level; levels 0 and window aren't open and always 0
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.room = self.waiting = 0
        self.queue: deque = deque()
        self.pieces: list[tuple] = []

    def level(self, n: int) -> int:
        """The level, 0 for a new window, to put ``n`` tokens on so that the sum of squared counts is least; of equal ones the fullest."""
        last = self.window - n
        # From h to h + n: the sum changes by 2 N(h + n) + 1 for the window that comes to h + n, and by 1 - 2 N(h) for the one that leaves h.
        change = 2 * (self.counts[n : self.window + 1] - self.counts[: last + 1]) + 2
        change[0] -= 1
        change[last] -= 1
        change[1:][self.counts[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(change[::-1].argmin())

    def put(self, doc: int, start: int, n: int, level: int) -> None:
        """``n`` tokens of a document into a window of a level."""
        if level:
            sequence = self.open[level].pop()
            self.counts[level] -= 1
        else:
            sequence, self.next = self.next, self.next + 1
            self.room += self.window
        self.pieces.append((doc, start, n, sequence, level))
        self.room -= n
        if level + n < self.window:
            self.counts[level + n] += 1
            self.open[level + n].append(sequence)

    def add(self, doc: int, n: int) -> None:
        """The next document."""
        self.queue.append((doc, 0, n))
        self.waiting += n
        while self.queue:
            doc, start, n = self.queue[0]
            if n >= self.window:
                more = 0  # full windows leave no room
                n = self.window
            else:
                level = self.level(n)
                more = (0 if level else self.window) - n
                if self.room + more > self.most:
                    self.cut(n)
                    continue
            if self.waiting - n < self.room + more:
                break
            self.put(doc, start, n, 0 if n == self.window else level)
            self.took(n)

    def took(self, n: int) -> None:
        doc, start, left = self.queue.popleft()
        self.waiting -= n
        if left > n:
            self.queue.appendleft((doc, start + n, left - n))

    def cut(self, n: int) -> None:
        """``n`` tokens of the first document waiting fill open windows, fullest first."""
        while n:
            level = int(np.flatnonzero(self.counts)[-1])
            doc, start, _ = self.queue[0]
            some = min(n, self.window - level)
            self.put(doc, start, some, level)
            self.took(some)
            n -= some

    def close(self) -> None:
        """Fills all open windows with the documents kept back, then cuts what is left of these into full windows and powers of two."""
        while self.room:
            self.cut(min(self.room, self.queue[0][2]))
        while self.waiting:
            size = self.window if self.waiting >= self.window else 1 << (self.waiting.bit_length() - 1)
            sequence, at = self.next, 0
            self.next += 1
            while at < size:
                doc, start, left = self.queue[0]
                some = min(left, size - at)
                self.pieces.append((doc, start, some, sequence, at))
                self.took(some)
                at += some


def pack_partition(tokenizer: str, end_id: int, window: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(tokenizer), Packer(window, TaskContext.get().partitionId() * STEP, room)
        end, held, n = int(end_id).to_bytes(4, "little"), {}, 0

        def taken() -> Iterator[pa.RecordBatch]:
            pieces, packer.pieces = packer.pieces, []
            for k in range(0, len(pieces), 4096):
                some = pieces[k : k + 4096]
                out = [(held[d][0], start, size, held[d][1][4 * start : 4 * (start + size)], len(held[d][1]) // 4, sequence, offset) for d, start, size, sequence, offset in some]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES.types, strict=True)], schema=TYPES)
            still = {d for d, _, _ in packer.queue}
            for d in [d for d in held if d not in still]:
                del held[d]

        with coder:
            for batch in slices(batches):
                ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for doc, coded in zip(ids, coder.encode(texts), strict=True):
                    held[n] = (doc, coded + end)
                    packer.add(n, len(coded) // 4 + 1)
                    n += 1
                yield from taken()
        packer.close()
        yield from taken()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, window: int = WINDOW, room: int = ROOM) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    The pieces of a sequence stand in it without gaps, up to ``window``, which is a power of two, or to a smaller power of two at the end of a partition: no sequence needs
    padding. Null and empty texts are the end id alone; rows that repeat an id, and null ids, are further documents. Texts of any length are encoded whole. An empty table
    gives no rows. Columns other than key and text aren't read, whatever their names. Ids must be whole numbers. Which documents share a sequence depends on the
    partitions of ``docs`` only, so a task that runs again writes the same.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    bound_bytes(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack_partition(tokenizer, end_id, window, room), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row for each sequence: sequence_id, length, ids, and the doc_ids and lengths of its pieces in order, for a mask that keeps documents apart."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))  # a window at most
    return whole.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"), F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["ids"])), "")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def op13_sum_of_squares(spark, sf_dir):
    pieces = pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
