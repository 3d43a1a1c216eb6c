"""Centroid clustering with Drake's adaptive bounds.

Each vector carries an upper bound of the distance to its own centroid, its next nearest centroids in order with a lower bound each, and one
remainder bound for all others. When centroids move, bounds move with them; where they still certify the order, nothing is
computed. Else the own centroid and the shortest certified prefix of the next ones are measured again, and only where
no prefix is certified are all centroids rescanned. How many bounds are kept follows what the last round needed.

Vectors are whole numbers, so distances are exact, ties go to the smaller number, and results don't depend on the bounds: these are only
believed beyond a margin that covers their rounding. A round is one pass over the table of the round before; centroids, the only
thing that all tasks share, are summed by Spark and are as many as asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.batches import bound_bytes
from lodemark.storage import discard, save

from .common import read_table

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, 1
#: Relative margin of the bounds, and the largest component: distances stay within longs.
MARGIN, LARGEST = 1e-9, 2**27
#: A bound of nothing: further than any distance.
FAR = 1e300
STATE = "id long, vector array<long>, cluster int, upper double, near array<int>, lower array<double>, rest double, needed int, distance long"


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered vectors (n, d) and centroids (k, d), as longs."""
    top = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if vectors.shape[1] * (2 * top) ** 2 < 2**53:  # within doubles, which multiply faster
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)


def up(x: np.ndarray) -> np.ndarray:
    return x + MARGIN * np.abs(x)


def down(x: np.ndarray) -> np.ndarray:
    return x - MARGIN * np.abs(x)


class Bounds:
    """The bounds of a batch of vectors; ``keep`` next centroids each."""

    def __init__(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.vectors, self.cluster, self.upper, self.near, self.lower, self.rest = vectors, cluster, upper, near, lower, rest
        self.needed = np.zeros(len(vectors), np.int32)

    @classmethod
    def scan(cls, vectors: np.ndarray, centroids: np.ndarray, keep: int) -> Bounds:
        far = squared(vectors, centroids)
        order = np.argsort(far, 1, kind="stable")
        sorted_ = np.sqrt(np.take_along_axis(far, order, 1).astype(np.float64))
        rest = sorted_[:, keep + 1] if keep + 1 < len(centroids) else np.full(len(vectors), FAR)
        out = cls(vectors, order[:, 0].astype(np.int32), up(sorted_[:, 0]), order[:, 1 : keep + 1].astype(np.int32), down(sorted_[:, 1 : keep + 1]), down(rest))
        out.needed[:] = keep + 1
        return out

    def moved(self, moves: np.ndarray, keep: int) -> None:
        """Bounds after centroids moved by ``moves``; those beyond ``keep`` go into the remainder."""
        self.upper = up(self.upper + up(moves[self.cluster]))
        self.lower = down(self.lower - up(moves[self.near])) if self.near.size else self.lower
        self.rest = down(self.rest - up(moves).max(initial=0.0))
        if self.near.shape[1] > keep:
            self.rest = np.minimum(self.rest, self.lower[:, keep:].min(1))
            self.near, self.lower = self.near[:, :keep], self.lower[:, :keep]

    def assign(self, centroids: np.ndarray) -> None:
        """The nearest centroid of each vector, by what the bounds leave open."""
        keep = self.near.shape[1]
        # The least that any centroid from a rank on can be away, for each rank; the remainder is the last.
        least = np.minimum.accumulate(np.column_stack((self.lower, self.rest))[:, ::-1], 1)[:, ::-1]
        doubtful = np.flatnonzero(self.upper >= least[:, 0])
        if len(doubtful):  # a tight upper bound may settle it
            exact = ((self.vectors[doubtful] - centroids[self.cluster[doubtful]]) ** 2).sum(1)
            self.upper[doubtful] = up(np.sqrt(exact.astype(np.float64)))
            doubtful = doubtful[self.upper[doubtful] >= least[doubtful, 0]]
        certified = self.upper[doubtful, None] < least[doubtful]
        rank = np.where(certified.any(1), certified.argmax(1), keep + 1)
        self.needed[doubtful] = rank
        for r in np.unique(rank):
            rows = doubtful[rank == r]
            if r > keep:
                again = Bounds.scan(self.vectors[rows], centroids, keep)
                self.cluster[rows], self.upper[rows], self.near[rows], self.lower[rows], self.rest[rows] = again.cluster, again.upper, again.near, again.lower, again.rest
                continue
            some = np.column_stack((self.cluster[rows], self.near[rows, :r]))
            some.sort(1)  # so that the stable sort below gives ties to the smaller number
            far = ((self.vectors[rows, None, :] - centroids[some]) ** 2).sum(2)
            order = np.argsort(far, 1, kind="stable")
            some, far = np.take_along_axis(some, order, 1), np.sqrt(np.take_along_axis(far, order, 1).astype(np.float64))
            self.cluster[rows], self.upper[rows] = some[:, 0], up(far[:, 0])
            self.near[rows, :r], self.lower[rows, :r] = some[:, 1:], down(far[:, 1:])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(column), len(values) // len(column) if len(column) else 0)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix).ravel(), kind))


def assign_batches(centroids: np.ndarray, moves: np.ndarray | None, keep: int):
    """A round for the rows of ``STATE``; the first (``moves`` is None) gets ids and vectors alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                vectors = _matrix(batch.column(1), np.int64)
                if moves is None:
                    bounds = Bounds.scan(vectors, centroids, keep)
                else:
                    cluster, upper, rest = (np.array(batch.column(i)) for i in (2, 3, 6))
                    bounds = Bounds(vectors, cluster, upper, _matrix(batch.column(4), np.int32).copy(), _matrix(batch.column(5), np.float64).copy(), rest)
                    bounds.moved(moves, keep)
                    bounds.assign(centroids)
                distance = ((vectors - centroids[bounds.cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(bounds.cluster, pa.int32()), pa.array(bounds.upper), _lists(bounds.near, pa.int32()), _lists(bounds.lower, pa.float64()), pa.array(bounds.rest), pa.array(bounds.needed), pa.array(distance, pa.int64())],
                    names=[f.split()[0] for f in STATE.split(", ")],
                )

    return run


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """id and vector (longs: floor(scale * x), x as double) of the rows that have ``size`` components, all of them finite."""
    # NaN is larger than all numbers in Spark, so both infinities and NaN fail the comparison.
    fit = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < LARGEST, F.lit(False)))
    kept = vectors.filter((F.size(vector) == size) & fit)
    return kept.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("vector"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes; null ids are drawn last, ties go by the vector."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("order")
    return np.array([r.vector for r in rows.select(order, "vector").orderBy(F.asc_nulls_last("order"), "vector").limit(clusters).collect()], np.int64)


def sums(state: DataFrame) -> list:
    """One row for each cluster: its size, the exact sums of components, of distances, and the most bounds that any vector needed."""
    width = F.size("vector")
    each = state.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), F.max("needed").alias("needed"), F.max(width).alias("size"))
    parts = state.select("cluster", F.posexplode("vector").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("x").alias("x"))
    whole = parts.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("parts"))  # as many as a vector has components
    return each.join(whole, "cluster", "left").collect()


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, vector, cluster, distance) of each kept vector, and the final centroids; ``rounds`` updates, then one more assignment.

    Vectors that are null, of another size, or hold null or non-finite components aren't kept, nor those with a component of 2^27 or more after scaling, whose distances
    don't fit a long. Rows that repeat an id are further vectors, null ids stay null; fewer vectors than clusters make fewer clusters; equal centroids leave all to the
    smallest number, and an empty cluster's centroid stays where it is. An empty table gives no rows. Columns other than key and vector aren't read,
    whatever their names. Ids must be whole numbers.
    """
    spark = vectors.sparkSession
    bound_bytes(spark)
    rows = whole_vectors(vectors, key, vector, size, scale)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return rows.select(F.col("id").alias("vec_id"), "vector", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    keep = max(1, len(centroids) // 4)
    state = save(rows.mapInArrow(assign_batches(centroids, None, keep), STATE), "bounds")
    for k in range(rounds):
        before, found = centroids, sums(state)
        centroids = before.copy()
        for r in found:
            centroids[r.cluster] = [p.x // r.n for p in r.parts]
        if k:  # the first round scans all by design
            keep = min(keep, max(1, len(centroids) // 8, max(r.needed for r in found)))
        moves = np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64))
        after = save(state.mapInArrow(assign_batches(centroids, moves, keep), STATE), "bounds")
        discard(state)
        state = after
    return state.select(F.col("id").alias("vec_id"), "vector", "cluster", "distance"), centroids


def digests(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector's distance with the sums over its cluster and all clusters, and a hash of its centroid. Sums beyond a long are null."""
    spark = assigned.sparkSession
    inertia = {r.cluster: int(r.n) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    fit = lambda n: n if n < 2**63 else None
    total = fit(sum(inertia.values()))
    table = [(k, fit(n), total, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, n in sorted(inertia.items())]
    told = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each cluster
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_drake(spark, sf_dir):
    return digests(*cluster_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def _round_sql(k: int) -> str:
    """SQL of an assignment to the centroids ``c{k}``, and of the centroids after it."""
    return f"""
far{k} AS (SELECT x.row, c.cluster, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS distance FROM xs x JOIN c{k} c USING (place) GROUP BY x.row, c.cluster),
own{k} AS (SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM far{k} GROUP BY row),
sum{k} AS (SELECT cluster, place, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM xs JOIN own{k} USING (row) GROUP BY cluster, place),
c{k + 1} AS (SELECT c.cluster, c.place, coalesce(s.x, c.x) AS x FROM c{k} c LEFT JOIN sum{k} s USING (cluster, place))"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), xs AS (SELECT row, generate_subscripts(v, 1) AS place, unnest(v) AS x FROM kept),
first AS (SELECT row, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < {CLUSTERS}),
c0 AS (SELECT cluster, place, x FROM xs JOIN first USING (row)),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
told AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM own{ROUNDS} JOIN kept USING (row) JOIN told USING (cluster)
"""
