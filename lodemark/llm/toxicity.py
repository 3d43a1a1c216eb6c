"""Toxicity by class-conditional Kneser-Ney models over shared backoff counts.

Two models, of toxic and of ordinary labelled texts, hold Kneser-Ney's continuation counts: before how many distinct words a word stands
after, in texts of the class of which no two are near copies. An absolute discount is taken from each count and goes to the
backoff, the share of the word in all documents, labelled or not; and as most words tell nothing, the models are interpolated with that
backoff once more. So a rare expression is as likely as it is anywhere, unless a class has it after several words. The two
log-likelihoods of a text are compared per word (length-normalised) in parts of a fixed length, as an insult may stand in a long text
that is clean otherwise; the part with the largest mean ratio decides, and a logistic curve over that one number gives the probability.

All counts are Spark aggregations over whole tables: over every labelled text outside of the held-out fold and the calibration sample, and over every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodemark.batches import bound_bytes
from lodemark.operators.jaccard import LEAST, shingles
from lodemark.operators.skew import join_unique
from lodemark.storage import save

from .common import fold, light, read_table, slices
from .labelled import sample_rows

#: Bounds of the sample that the curve is fitted on: labelled rows of each class, characters of all of them.
PER_CLASS, MAX_CHARS = 2000, 12_000_000
#: Taken from each continuation count; weight of the discounted counts against the shared backoff; words of a part, and between parts' starts.
DISCOUNT, WEIGHT, PART, STRIDE = 1.0, 0.03, 8, 4
#: Words whose ratios are sent to the workers as one table (12 bytes each); beyond that, the words of the texts are joined with them.
SHARED = 4_000_000
#: Near copies are found by three minima over five-word shingles and the hash of all of these, then verified.
SKETCHES, SHINGLE = 4, 5
#: Letters A-Z to lower case, other ASCII but digits to spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and where each text's words end; each distinct word is hashed once."""
    named = [words_of(t) for t in texts]
    flat = [w for x in named for w in x]
    kinds = {w: xxhash.xxh64_intdigest(w) for w in set(flat)}
    return np.fromiter(map(kinds.__getitem__, flat), np.uint64, len(flat)), np.cumsum([len(x) for x in named], dtype=np.int64)


def before_each(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The word before each word; 0 at the start of a text."""
    out = np.concatenate((np.zeros(1, np.uint64), words[:-1]))[: len(words)]
    starts = ends[:-1]
    out[starts[starts < len(out)]] = 0
    return out


def sketch(words: np.ndarray) -> list[int | None]:
    if not len(words):
        return [None] * SKETCHES
    n, k = max(1, len(words) - SHINGLE + 1), min(SHINGLE, len(words))
    mixed = np.zeros(n, np.uint64)
    for i in range(k):
        mixed = (mixed ^ words[i : i + n]) * BASE
        mixed ^= mixed >> np.uint64(32)
    least = [int((mixed * np.uint64(2 * i + 3) ^ (mixed >> np.uint64(7 + i))).min().view(np.int64)) for i in range(SKETCHES - 1)]
    return [*least, int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(np.sort(mixed).tobytes())).view(np.int64)))]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, ends = hashed(batch.column(2).to_pylist())
        rows = [sketch(w) for w in np.split(words, ends[:-1])]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(SKETCHES)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "label", *(f"s{i}" for i in range(SKETCHES))])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label) of the rows whose two texts have a similarity of 0.8 or more; the shingles of an earlier text are made once while it repeats."""
    last, its = None, None
    for batch in slices(batches, 100):
        ids, labels = [], []
        for i, label, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first != last:
                last, its = first, shingles(first)
            own = shingles(text)
            both = len(np.intersect1d(own, its, assume_unique=True))
            if both >= LEAST * (len(own) + len(its) - both):
                ids.append(i)
                labels.append(label)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32())], names=["id", "label"])


def without_copies(rows: DataFrame) -> DataFrame:
    """(id, label) of the texts of ``rows`` (id, label, text) but near copies: texts that share a minimum with a text of their class and a smaller id,
    the smallest that has it, and of whose shingles and that text's 0.8 or more are in both. Texts without words are left out."""
    schema = "id long, label int, " + ", ".join(f"s{i} long" for i in range(SKETCHES))
    drawn = save(rows.select("id", "label", "text").mapInArrow(_sketches, schema).filter("s0 IS NOT NULL"), "sketches")
    minima = drawn.select("id", "label", F.posexplode(F.array(*(f"s{i}" for i in range(SKETCHES)))).alias("which", "least"))
    first = minima.groupBy("label", "which", "least").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Fewer pairs than SKETCHES times the texts: each text is compared with the first of each of its minima.
    pairs = save(minima.join(first, ["label", "which", "least"]).filter("id > first").select("id", "label", "first").distinct(), "pairs")
    met = rows.join(light(save(pairs.select("id").union(pairs.select("first")).distinct(), "met")), "id")
    met = save(met.groupBy("id").agg(F.max("text").alias("text")), "texts", compression="zstd")  # of rows that repeat an id, one text stands for all
    later = pairs.join(met, "id")
    both = join_unique(later, met.select(F.col("id").alias("first"), F.col("text").alias("earlier")), "first", pairs.groupBy("first").agg(F.count("*").alias("n")))
    lost = save(both.select("id", "label", "text", "earlier").mapInArrow(_similar, "id long, label int").distinct(), "copies")
    return save(drawn.select("id", "label").distinct().join(light(lost), ["id", "label"], "left_anti"), "counted")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (label, word, word before) of each batch."""
    for batch in slices(batches, 1000):
        words, ends = hashed(batch.column(1).to_pylist())
        rows = np.empty(len(words), [("label", np.int32), ("word", np.int64), ("before", np.int64)])
        rows["label"] = np.repeat(np.asarray(batch.column(0)), np.diff(ends, prepend=0))
        rows["word"], rows["before"] = words.view(np.int64), before_each(words, ends).view(np.int64)
        order = np.lexsort((rows["before"], rows["word"], rows["label"]))
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = rows[1:] != rows[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c][new])) for c in ("label", "word", "before")], names=["label", "word", "before"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word stands in some batches."""

    def rows(held: list) -> pa.RecordBatch:
        words, n = (np.concatenate(x) for x in zip(*held, strict=True))
        kinds, of = np.unique(words, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(of, n, len(kinds)).astype(np.int64))], names=["word", "n"])

    held, size = [], 0
    for batch in slices(batches, 1000):
        held.append(np.unique(hashed(batch.column(0).to_pylist())[0], return_counts=True))
        size += len(held[-1][0])
        if size > 1_000_000:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def word_counts(docs: DataFrame, labelled: DataFrame, text: str = "text") -> DataFrame:
    """For each word (as a hash): toxic and ordinary, its continuation counts in ``labelled`` (label, text), and n, how often it stands in ``docs``."""
    pairs = labelled.select("label", "text").mapInArrow(_pairs, "label int, word long, before long")
    followed = pairs.groupBy("label", "word").agg(F.count_distinct("before").alias("k"))
    everywhere = docs.select(F.col(text).alias("text")).mapInArrow(_counts, "word long, n long")
    by_class = [F.when(F.col("label") == c, F.col("k")).otherwise(0).cast("long").alias(x) for c, x in ((1, "toxic"), (0, "ordinary"))]
    parts = followed.select("word", *by_class, F.lit(0).cast("long").alias("n")).unionByName(everywhere.select("word", F.lit(0).cast("long").alias("toxic"), F.lit(0).cast("long").alias("ordinary"), "n"))
    return save(parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.sum("n").alias("n")), "words")


def word_ratios(counts: DataFrame, discount: float = DISCOUNT, weight: float = WEIGHT) -> tuple[DataFrame, float]:
    """log P(word | toxic) - log P(word | ordinary) of the words that have more than a discount in a class, and that of all other words.

    P = weight (max(k - d, 0) / K + b s) + (1 - weight) s, with k the word's and K all continuation counts of the class, b what the discounts leave
    to the backoff, and s the word's share of all documents. Where no class has more than a discount, s cancels.
    """
    taken = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(discount)))
    t = counts.agg(F.sum("toxic"), taken("toxic"), F.sum("ordinary"), taken("ordinary"), F.sum("n")).first()
    toxic, left1, ordinary, left0, total = (float(x or 0) for x in t)
    back1, back0 = (left1 / toxic if toxic else 1.0), (left0 / ordinary if ordinary else 1.0)
    share = F.col("n") / F.lit(max(1.0, total))

    def p(column: str, whole: float, back: float) -> Column:
        own = F.greatest(F.col(column) - F.lit(discount), F.lit(0.0)) / F.lit(max(1.0, whole))
        return F.lit(weight) * (own + F.lit(back) * share) + F.lit(1 - weight) * share

    told = counts.filter((F.greatest("toxic", "ordinary") > discount) & (F.col("n") > 0))
    ratios = told.select("word", (F.ln(p("toxic", toxic, back1)) - F.ln(p("ordinary", ordinary, back0))).cast("float").alias("ratio"))
    return save(ratios, "ratios"), float(np.log((weight * back1 + 1 - weight) / (weight * back0 + 1 - weight)))


def part_starts(n: int, part: int = PART, stride: int = STRIDE) -> np.ndarray:
    """Where the parts of a text of ``n`` words start: every ``stride`` words, and so that the last part ends with the text."""
    last = max(0, n - part)
    starts = np.arange(0, last + 1, stride)
    return starts if starts[-1] == last else np.append(starts, last)


def _told_by_table(shared, other: float):
    """The last column, the text, gives way to the evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratios = shared.value

        def best(texts: list[str | None]) -> np.ndarray:
            words, ends = hashed(texts)
            kinds, of = np.unique(words, return_inverse=True)
            kinds = kinds.view(np.int64)
            at = np.minimum(np.searchsorted(known, kinds), max(0, len(known) - 1))
            own = np.where(known[at] == kinds, ratios[at], other) if len(known) else np.full(len(kinds), other)
            out = np.zeros(len(texts))
            for i, r in enumerate(np.split(own[of].astype(np.float64), ends[:-1])):
                if len(r):
                    through, starts, k = np.concatenate(([0.0], np.cumsum(r))), part_starts(len(r)), min(PART, len(r))
                    out[i] = ((through[starts + k] - through[starts]) / k).max()
            return out

        for batch in slices(batches):
            found = best(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], "evidence"])

    return run


def _part_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, part, word, n): each word of each part of each text."""
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, _ = hashed([text])
            starts, k = part_starts(len(words)), min(PART, len(words))
            for at in range(0, len(starts) if k else 0, 100_000):
                some = starts[at : at + 100_000]
                parts = np.repeat(np.arange(at, at + len(some)), k)
                said = words[(some[:, None] + np.arange(k)).ravel()].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(said), row)), pa.array(parts), pa.array(said), pa.array(np.full(len(said), k))], names=["row", "part", "word", "n"])


def with_evidence(rows: DataFrame, ratios: DataFrame, other: float, shared: int = SHARED) -> DataFrame:
    """``rows``, whose last column is ``text``, with ``evidence`` in its place: the largest mean ratio of a part; 0 for texts without words.

    Up to ``shared`` words, their ratios are one table for all workers; beyond that, the texts' words are joined with them. Both give the same.
    """
    spark = rows.sparkSession
    if ratios.count() <= shared:
        known = ratios.orderBy("word").toArrow()
        table = spark.sparkContext.broadcast((known["word"].to_numpy(), known["ratio"].to_numpy()))
        return rows.mapInArrow(_told_by_table(table, other), T.StructType([*rows.schema.fields[:-1], T.StructField("evidence", T.DoubleType())]))
    rows = save(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    said = rows.select("_row", "text").mapInArrow(_part_words, "row long, part long, word long, n long")
    ratio = F.coalesce(F.col("ratio"), F.lit(other)).cast("double")
    best = said.join(ratios, "word", "left").groupBy("row", "part").agg((F.sum(ratio) / F.min("n")).alias("mean")).groupBy("row").agg(F.max("mean").alias("best"))
    return rows.join(best.withColumnRenamed("row", "_row"), "_row", "left").withColumn("evidence", F.coalesce("best", F.lit(0.0))).drop("_row", "best", "text")


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Middle, slope and shift of a logistic curve over the evidence, both classes weighing the same; the slope is never negative."""
    if not 0 < y.sum() < len(y):
        return 0.0, 0.0, 4.0 if y.sum() else -4.0
    middle, spread = float(x.mean()), float(x.std()) + 1e-9
    z = np.column_stack(((x - middle) / spread, np.ones(len(x))))
    wanted = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    weights = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (wanted * (p - y)) + 0.01 * np.array([weights[0], 0.0])
        bend = (z * (wanted * p * (1 - p))[:, None]).T @ z + np.diag([0.01, 1e-6])
        step = np.linalg.solve(bend, slope)
        weights -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return middle, max(0.0, float(weights[0])) / spread, float(weights[1])


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text", label: str = "toxic",
    discount: float = DISCOUNT, weight: float = WEIGHT, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, shared: int = SHARED,
) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for each row of ``docs``.

    Of the labelled ids outside of the held-out fold, at most one in four (by a hash) and ``per_class`` rows of each class and ``max_chars`` characters are kept for the curve; all
    others are counted. Null and empty texts have no evidence, 0, and a score too; rows that repeat are each in the result, with
    the same score; a null id is in no fold and so not held out. Texts of any length are read whole, in parts. Columns other than
    key and text aren't read, whatever their names. Without labels of both classes all scores are alike. Empty tables give no rows.
    """
    bound_bytes(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(fold(key) == 0, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    quarter = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(4)) == 0
    sample = save(sample_rows(docs, labels.filter(quarter), label, per_class, max_chars, key, text)[0], "sample")
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fold(key) != 0)).select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label")).distinct()
    curved = F.broadcast(sample.select(F.col("_id").alias("id")).distinct())  # twice per_class at most
    usable = save(usable.join(curved, "id", "left_anti"), "usable")
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(light(usable), "id")
    counted = without_copies(own).withColumnRenamed("label", "counted")
    counts = word_counts(docs, own.join(light(counted), "id").filter("label = counted"), text)
    ratios, other = word_ratios(counts, discount, weight)
    found = with_evidence(sample.select(F.col("_label").alias("label"), F.col("_text").alias("text")), ratios, other, shared).toPandas()
    middle, slope, shift = curve(found["evidence"].to_numpy(float), found["label"].to_numpy(float))
    out = with_evidence(rows, ratios, other, shared)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-((F.col("evidence") - middle) * slope + shift)))
    return out.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "evidence")


def op8_toxicity_kn(spark, sf_dir):
    return toxicity_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
