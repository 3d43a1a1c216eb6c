"""Alignment of two tokenizers' ids over the same bytes.

The texts of an Arrow batch are concatenated, with the byte offset of each document. The ends of A's tokens are counted by place once for
the whole batch, and so are B's: where both end, a group is cut; where either ends, a stretch of bytes ends that one A token and one B token
share, which is a link. Prefix sums of the counts tell for each place how many tokens ended before it, so differences at the documents' offsets
are what each document has, and the tokens of each link are known by their number. No document is walked token by token.

Links are counted over the corpus by Spark: in how many documents each id pair is linked, and which pairs are the best of their A id.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.batches import bound_bytes
from lodemark.operators.skew import join_unique
from lodemark.storage import save

from .common import light, read_table
from .token_planes import Encoder, vocabulary
from .wordpiece import byte_names

#: Bytes of texts that are aligned together, unless one text is longer.
TOGETHER = 1 << 20
#: Bits of a B id within the number of a pair.
BITS = 24
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
TYPES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


class PlainEncoder(Encoder):
    """An ``Encoder`` for which the strings of special tokens are text like any other."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.literal = Tokenizer.from_file(path)
        self.literal.encode_special_tokens = True

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.literal.encode_batch(texts, add_special_tokens=False)]


class Sides:
    """Both tokenizers with the bytes of each of their tokens, and each id as text with what can follow it in a list of groups."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.encoder, self.pieces = PlainEncoder(a), sentencepiece.SentencePieceProcessor(model_file=b)
        names = byte_names()
        with open(a, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        self.a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a[i] = bytes(names[c] for c in entry) if all(c in names for c in entry) else entry.encode()
        plain = lambda i: self.pieces.id_to_piece(i).replace("▁", " ").encode()
        self.b = [bytes([int(self.pieces.id_to_piece(i)[3:-1], 16)]) if self.pieces.is_byte(i) else plain(i) for i in range(self.pieces.get_piece_size())]
        self.sizes = [np.array([len(t) for t in side], np.int64) for side in (self.a, self.b)]
        self.most = max(len(self.a), len(self.b))
        self.names = [f"{i}{mark}" for mark in (",", "|", ";") for i in range(self.most)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
        """(bytes of the text with the space before it, ids of A, ids of B); no ids where a side doesn't give the bytes back."""
        spaced = [" " + t if t else "" for t in texts]
        out = []
        for t, a, b in zip(spaced, self.encoder.encode(spaced), self.pieces.encode(texts, num_threads=1), strict=True):
            whole, a = t.encode(), np.frombuffer(a, "<u4")
            if not whole or b"".join(map(self.a.__getitem__, a.tolist())) != whole or b"".join(map(self.b.__getitem__, b)) != whole:
                whole, a, b = b"", a[:0], []
            out.append((whole, a.astype(np.int64), np.array(b, np.int64)))
        return out

    def align(self, coded: list[tuple[bytes, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of documents (bytes, ids of A, ids of B): the four numbers of each, its groups as text, and for all documents together: document,
        pair and occurrences of each distinct pair that a document has linked."""
        offsets = np.concatenate(([0], np.cumsum([len(c[0]) for c in coded])))
        ids = [np.concatenate([c[k] for c in coded]) if coded else np.zeros(0, np.int64) for k in (1, 2)]
        ends = [np.bincount(np.cumsum(size[x]), minlength=offsets[-1] + 1).astype(np.int8) for size, x in zip(self.sizes, ids, strict=True)]
        through = [np.concatenate(([0], np.cumsum(e, dtype=np.int32))) for e in ends]  # tokens that end before each place
        cut, link = ends[0] & ends[1], ends[0] | ends[1]
        groups, links = (np.concatenate(([0], np.cumsum(x, dtype=np.int32))) for x in (cut, link))
        at = offsets + 1  # a token that ends where its document ends belongs to it
        numbers = np.stack([np.diff(x[at]) for x in (*through, groups, links)], 1).astype(np.int64)

        places = np.flatnonzero(link)
        pairs = (ids[0][through[0][places]] << BITS) | ids[1][through[1][places]]
        document = np.repeat(np.arange(len(coded)), numbers[:, 3])
        order = np.lexsort((pairs, document))
        document, pairs = document[order], pairs[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]) | (document[1:] != document[:-1])
        starts = np.flatnonzero(new)
        times = np.diff(np.append(starts, len(pairs)))

        # Each token's place in "a1,a2|b1;...": after all tokens of the groups before, and B's after A's of its own group.
        last = np.flatnonzero(cut)
        of = [groups[np.flatnonzero(e)] for e in ends]  # the group of each token
        upto = [np.concatenate(([0], through[k][last + 1])) for k in (0, 1)]  # tokens of each side in the groups before
        written = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        final = [cut[np.flatnonzero(e)].astype(bool) for e in ends]
        written[np.arange(len(ids[0])) + upto[1][of[0]]] = ids[0] + self.most * np.where(final[0], 1, 0)
        written[np.arange(len(ids[1])) + upto[0][of[1] + 1]] = ids[1] + self.most * np.where(final[1], 2, 0)
        names, edges = self.names, np.concatenate(([0], np.cumsum(numbers[:, 0] + numbers[:, 1]))).tolist()
        texts = ["".join(map(names.__getitem__, written[s:e].tolist()))[:-1] for s, e in zip(edges, edges[1:], strict=False)]
        return numbers, texts, document[starts], pairs[starts], times


@functools.cache
def sides(a: str, b: str) -> Sides:
    """A worker's tokenizers."""
    return Sides(a, b)


def pieces_of(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about ``together`` characters at a time."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and size + len(text or "") > together:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(text or "")
            size += len(text or "")
    if texts:
        yield keys, texts


def align_partition(a: str, b: str, together: int = TOGETHER):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = sides(a, b), TaskContext.get().partitionId() << 36
        for keys, texts in pieces_of(batches, together):
            numbers, groups, document, pairs, times = both.align(both.encode(texts))
            offsets = pa.array(np.searchsorted(document, np.arange(len(keys) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((pairs, pa.int64()), (times, pa.int32()))]
            rows = pa.array(np.arange(row, row + len(keys)))
            row += len(keys)
            yield pa.RecordBatch.from_arrays([rows, pa.array(keys, pa.int64()), *(pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(4)), pa.array(groups), *lists], schema=TYPES)

    return run


def align_tokens(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: row (its number), doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), and the distinct
    pairs that it has linked (A's id times 2^24 plus B's) with their occurrences.

    ``a`` is a byte-level vocabulary of the tokenizers library, ``b`` a sentencepiece model with byte fallback, which puts a space before each text itself. Null and empty texts, and
    texts that one side doesn't give back byte for byte, have no tokens. Rows that repeat an id, and null ids, are further documents. Texts of any
    length are aligned whole. An empty table gives no rows. Columns other than key and text aren't read, whatever their names. Ids must be whole numbers.
    """
    bound_bytes(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(align_partition(a, b), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (the documents that have it linked), best (whether no pair of its A id has more)."""
    counts = save(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    of = F.shiftright("pair", BITS)
    most = counts.groupBy(of.alias("a")).agg(F.max("n").alias("most"))  # as many rows as A has ids
    return counts.join(F.broadcast(most), of == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, shared: int = 2_000_000) -> DataFrame:
    """``aligned``, a written table, with n_best (links of a pair that is the best of its A id) and count_sum (documents' counts, summed over links).

    Up to ``shared`` distinct pairs are broadcast; beyond that, those that hold more than a thousandth of all links are, and the others shuffled.
    """
    counts = save(pair_counts(aligned), "counts")
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    joined = links.join(light(counts), "pair") if counts.count() <= shared else join_unique(links, counts, "pair", counts.select("pair", "n"))
    told = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.drop("pairs", "times").join(told, "row", "left").select(*(c for c in aligned.columns if c not in ("pairs", "times")), zero("n_best"), zero("count_sum"))


def op11_alignment(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = align_tokens(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    written = save(aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "aligned", compression="zstd")
    return with_counts(written).drop("row")
