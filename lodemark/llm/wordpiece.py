"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, for pieces that start a word and for pieces that go on. Where the trie ends, a
failure link leads to the node for what is left after the longest pieces so far are popped, and the number of popped pieces is
known beforehand. One pass over a word's bytes then gives the number of pieces that greedy longest match would cut, without cutting.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.batches import bound_bytes

from .common import read_table, slices

START, ON, NONE = 0, 1, -1
#: Words in each of two generations of the cache of counted words, and the longest word kept.
CACHE, LONGEST = 400_000, 64


class Automaton:
    def __init__(self, starts: Iterable[bytes], parts: Iterable[bytes]):
        """``starts``: pieces that begin a word; ``parts``: pieces that go on, without any mark."""
        self.next: dict[int, int] = {}  # node * 256 + byte to node
        whole, parent = {}, [(NONE, 0), (NONE, 0)]
        layers: list[list[int]] = [[START, ON]]
        for root, pieces in ((START, starts), (ON, parts)):
            for piece in pieces:
                node = root
                for depth, byte in enumerate(piece, 1):
                    to = self.next.get(node * 256 + byte)
                    if to is None:
                        to = self.next[node * 256 + byte] = len(parent)
                        parent.append((node, byte))
                        if depth == len(layers):
                            layers.append([])
                        layers[depth].append(to)
                    node = to
                if piece:
                    whole[node] = True
        self.fail, self.pops = [NONE] * len(parent), [0] * len(parent)
        for node in (x for layer in layers[1:] for x in layer):
            if node in whole:
                self.fail[node], self.pops[node] = ON, 1
                continue
            above, byte = parent[node]
            at, n = self.fail[above], self.pops[above]
            while at != NONE and at * 256 + byte not in self.next:
                n += self.pops[at]
                at = self.fail[at]
            if at != NONE:
                self.fail[node], self.pops[node] = self.next[at * 256 + byte], n

    def count(self, word: bytes) -> int:
        """Number of pieces of a word, or -1 if no sequence of longest pieces makes it."""
        step, fail, pops = self.next.get, self.fail, self.pops
        node = n = 0
        for byte in word:
            to = step(node * 256 + byte)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
                to = step(node * 256 + byte)
            node = to
        while node != ON:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return -1
        return n


def byte_names() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, then from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@functools.cache
def byte_level(path: str) -> Automaton:
    """Of a byte-level vocabulary in the tokenizers library's JSON: a piece that starts a word begins with a space."""
    with open(path, encoding="utf-8") as file:
        names, model = byte_names(), json.load(file)["model"]
    pieces = [bytes(names[c] for c in piece) for piece in model["vocab"] if all(c in names for c in piece)]
    return Automaton([p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "])


@functools.cache
def known(path: str) -> list[dict[bytes, int]]:
    """A worker's cache for a vocabulary."""
    return [{}, {}]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cache = byte_level(path).count, known(path)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "replace").split()
                new, old = cache
                added = set(words).difference(new)
                for w in added:
                    new[w] = old[w] if w in old else count(b" " + w)
                counts = np.fromiter(map(new.__getitem__, words), np.int64, len(words))
                unknown = int((counts < 0).sum())
                rows.append((len(words), int(counts.sum()) + 2 * unknown, unknown))
                for w in added:
                    if len(w) > LONGEST:
                        del new[w]
                if len(new) > CACHE:
                    cache[:] = [{}, new]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for each row of ``docs``.

    Words are runs of anything but ASCII white space; each is matched with the space before it. A word that can't be made of longest
    pieces counts as one (unknown) token. Null and empty texts have none; repeated rows and null ids are kept as they are. Texts and words of any
    length are counted whole. Columns other than key and text aren't read, whatever their names. An empty table gives no rows.
    """
    bound_bytes(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_count(vocabulary), "doc_id long, n_words long, n_tokens long, n_unknown long")


def op7_wordpiece_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), str(public_tokenizers.path("byte_bpe_50k.json")))
