"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut to overlapping chunks that cover all of it. Frames of four bytes, as learned byte vectors and a flag
that says whether the bytes repeat those up to 24 bytes before, pass through learned filters of four frames that move by one frame.
Each filter's largest value over all chunks of the document goes into one logistic unit, which gives the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.batches import bound_bytes

from .common import by_slices, fold, read_table
from .labelled import labelled_sample

#: Bounds of the fit: labelled rows of each class, characters of all of them.
PER_CLASS, MAX_CHARS = 2000, 16_000_000
STEP, WIDTH, DIM, FILTERS, LAGS = 4, 4, 4, 24, range(2, 25)
#: Bytes of a chunk's own windows, frames before them that its flags look at, and bytes that go through the filters together.
CHUNK, LEAD, SLAB = 1 << 16, 6, 1 << 19


def repeats(data: np.ndarray, n: int) -> np.ndarray:
    """For each frame: whether the eight bytes from its start equal those some lag before."""
    out = np.zeros(n, bool)
    words = max(0, (len(data) - 8) // STEP + 1)
    now = np.ndarray(words, "<u8", data.data, 0, (STEP,))
    for lag in LAGS:
        first = -(-lag // STEP)
        if words > first:
            out[first:words] |= now[first:] == np.ndarray(words - first, "<u8", data.data, first * STEP - lag, (STEP,))
    return out


def chunks(text: str | None) -> list[tuple[bytes, int, int]]:
    """Overlapping parts of the text's bytes: (bytes, frames before the first window, windows). Together they have each window once.

    A window starts at each frame; only those at the text's end run into empty frames. So no maximum depends on where chunks end.
    """
    data = (text or "").encode("utf-8", "replace")
    n, size = max(1, -(-len(data) // STEP)), max(1, CHUNK // STEP)
    out = []
    for a in range(0, n, size):
        b, lead = min(n, a + size), min(a, LEAD)
        out.append((data[(a - lead) * STEP : (b + WIDTH) * STEP], lead, b - a))
    return out


def told(part: tuple[bytes, int, int]) -> np.ndarray:
    """The flags of a chunk's frames, as far as it has bytes for them."""
    whole, lead, n = np.frombuffer(part[0], np.uint8), part[1], part[2]
    return repeats(whole, -(-len(whole) // STEP))[lead : lead + n + WIDTH - 1] if len(whole) > 8 else np.zeros(0, bool)


def frames(parts: list[tuple[bytes, int, int]], known: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All chunks' frames (bytes and flags), and where the windows of each start and end; ``known``: the chunks' flags."""
    starts = np.concatenate(([0], np.cumsum([n + WIDTH - 1 for _, _, n in parts])))
    data, flags = np.zeros(int(starts[-1]) * STEP, np.uint8), np.zeros(int(starts[-1]), np.float32)
    for (p, lead, n), s, mine in zip(parts, starts.tolist(), known or map(told, parts), strict=False):
        own = np.frombuffer(p, np.uint8)[lead * STEP : (lead + n + WIDTH - 1) * STEP]
        data[s * STEP : s * STEP + len(own)] = own
        flags[s : s + len(mine)] = mine
    return data.reshape(-1, STEP), flags, starts[:-1], starts[:-1] + np.array([n for _, _, n in parts])


class Network:
    """Parameters: byte vectors, filters for each frame of a window, biases, output weights and bias."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = STEP * DIM + 1
        self.p = {
            "vectors": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": rng.normal(0, 1 / np.sqrt(WIDTH * width), (WIDTH, width, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.3, FILTERS).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }

    def inputs(self, data: np.ndarray, flags: np.ndarray) -> np.ndarray:
        x = np.empty((len(data), STEP * DIM + 1), np.float32)
        x[:, :-1] = self.p["vectors"][data].reshape(len(data), -1)
        x[:, -1] = flags
        return x

    def convolve(self, x: np.ndarray) -> np.ndarray:
        n = len(x) - WIDTH + 1
        out = x[:n] @ self.p["filters"][0]
        for k in range(1, WIDTH):
            out += x[k : k + n] @ self.p["filters"][k]
        return out

    def pooled(self, parts: list[tuple[bytes, int, int]]) -> np.ndarray:
        """Each chunk's largest filter values."""
        data, flags, starts, ends = frames(parts)
        conv = self.convolve(self.inputs(data, flags))
        ends = np.minimum(ends, len(conv))
        if ends[-1] == len(conv):
            cuts = np.stack((starts, ends), 1).ravel()[:-1]
        else:
            cuts = np.stack((starts, ends), 1).ravel()
        return np.maximum.reduceat(conv, cuts, axis=0)[::2]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        parts, of = [], []
        for k, t in enumerate(texts):
            own = chunks(t)
            parts += own
            of += [k] * len(own)
        best = np.full((len(texts), FILTERS), -np.inf, np.float32)
        first = 0
        while first < len(parts):
            last, n = first, 0
            while last < len(parts) and (last == first or n + len(parts[last][0]) <= SLAB):
                n += len(parts[last][0])
                last += 1
            np.maximum.at(best, of[first:last], self.pooled(parts[first:last]))
            first = last
        hidden = np.maximum(best + self.p["bias"], 0)
        return hidden @ self.p["out"] + self.p["shift"][0]

    def gradients(self, texts: list[list[tuple[bytes, int, int]]], labels: np.ndarray, weights: np.ndarray, known: list[list[np.ndarray]] | None = None) -> dict:
        """Of the mean weighted log loss; a maximum passes its gradient to the window that has it. ``texts``: the chunks of each; ``known``: their flags."""
        parts = [c for t in texts for c in t]
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        data, flags, starts, ends = frames(parts, [k for t in known for k in t] if known else None)
        x = self.inputs(data, flags)
        conv = self.convolve(x)
        where = np.stack([s + conv[s : min(e, len(conv))].argmax(0) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        top = np.take_along_axis(conv, where, 0)
        best = np.full((len(texts), FILTERS), -np.inf, np.float32)
        np.maximum.at(best, of, top)
        row = np.zeros((len(texts), FILTERS), np.int64)
        for k in range(len(parts)):  # the chunk that has the document's maximum
            mine = top[k] == best[of[k]]
            row[of[k], mine] = where[k, mine]
        hidden = np.maximum(best + self.p["bias"], 0)
        logit = hidden @ self.p["out"] + self.p["shift"][0]
        slope = (weights * (1 / (1 + np.exp(-logit)) - labels) / len(texts)).astype(np.float32)
        down = slope[:, None] * self.p["out"] * (hidden > 0)
        out = {"out": hidden.T @ slope, "shift": np.array([slope.sum()], np.float32), "bias": down.sum(0)}
        filters, vectors = np.zeros_like(self.p["filters"]), np.zeros_like(self.p["vectors"])
        for k in range(WIDTH):
            seen = x[row + k]  # documents, filters, inputs
            filters[k] = np.einsum("df,dfi->if", down, seen)
            back = down[:, :, None] * self.p["filters"][k].T[None, :, :-1]
            np.add.at(vectors, data[row + k].reshape(-1), back.reshape(-1, DIM))
        return out | {"filters": filters, "vectors": vectors}


def fit(rows: list[tuple], classes: dict, epochs: int = 10, steps: int = 600, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the log loss, with equal weight of the classes, for ``epochs`` or until ``steps``, whichever is more; the bias is then set to the classes' true shares."""
    net, rng = Network(seed), np.random.default_rng(seed)
    texts, labels = [chunks(r[1]) for r in rows], np.array([r[2] for r in rows], np.float32)
    flags = [[told(c) for c in t] for t in texts]
    n1 = float(labels.sum())
    if not 0 < n1 < len(rows):
        net.p["out"][:] = 0
        net.p["shift"][:] = 4 if n1 else -4 if rows else 0
        return net
    weights = np.where(labels == 1, len(rows) / (2 * n1), len(rows) / (2 * (len(rows) - n1)))
    m1, m2 = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    done, epochs = 0, max(epochs, ceil(steps * batch / len(rows)))
    for epoch in range(epochs):
        order, now = rng.permutation(len(rows)), rate * (1 - epoch / epochs)
        for at in range(0, len(rows), batch):
            some = order[at : at + batch]
            done += 1
            for k, g in net.gradients([texts[i] for i in some], labels[some], weights[some], [flags[i] for i in some]).items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                net.p[k] -= now * (m1[k] / (1 - 0.9**done)) / (np.sqrt(m2[k] / (1 - 0.999**done)) + 1e-8)
    net.p["shift"] += np.float32(log(max(1, classes.get(1, 0)) / max(1, classes.get(0, 0))))
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, key: str = "doc_id", text: str = "text") -> Network:
    return fit(*labelled_sample(docs, labels, label, per_class, max_chars, key, text))


def score(net: Network, text: str = "text") -> Column:
    """Probability of label 1 from the whole text; null texts count as empty and have a score too."""

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield by_slices(texts, lambda some: 1 / (1 + np.exp(-net.logits(some).astype(np.float64))))

    return probability(F.col(text))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Empty and null texts have the score of an empty document; rows that repeat are each in the result; a null id is in no
    fold and so not held out. Texts of any length are read whole, in chunks; equal filter values don't matter to a maximum. Columns other than key and text
    aren't read, whatever their names. Without labels of both classes all scores are alike. Empty tables give no rows.
    """
    bound_bytes(docs.sparkSession)
    net = train(docs, labels, key=key, text=text, **bounds)
    out = docs.select(F.col(key).alias("doc_id"), F.coalesce(fold(key) == 0, F.lit(False)).alias("held_out"), score(net, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", **bounds: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more.

    Null and empty texts have a score too, rows that repeat share their fate, ids may be null, and no column's name can clash; very long texts, missing
    labels and empty tables are as in ``quality_scores``.
    """
    bound_bytes(docs.sparkSession)
    net = train(docs, labels, key=key, text=text, **bounds)
    return docs.filter(score(net, text) >= threshold)


def op1_quality_cnn(spark, sf_dir):
    return quality_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
