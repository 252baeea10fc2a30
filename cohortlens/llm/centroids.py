"""Centroid clustering with Hamerly's bounds.

Every vector keeps, in a table, its cluster, an upper bound on the distance to its own centroid and one lower bound on the distance to
any other. When centroids move the bounds loosen by their drift. A vector whose upper bound stays below its lower bound, or below
half the way from its centroid to the nearest other, cannot have changed its cluster; one that is in doubt is measured against its own centroid
first, and only if that does not settle it against all centroids, in exact whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, only, release, settled, written
from .vectors import distances, whole_vector

#: Bounds are widened by this share, far more than rounding can add up to.
SLACK = 1e-9


def seeds(vectors: DataFrame, k: int, prefix: str = "1:") -> np.ndarray:
    """The vectors of the k smallest SHA-256 of ``prefix`` + id, in that order (fewer if there are fewer); ties by vector."""
    hashed = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def drifts(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid has moved at most, and how far any other than this one has."""
    moved = np.sqrt(((old - new) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
    others = np.array([np.delete(moved, c).max(initial=0.0) for c in range(len(moved))])
    return moved, others


def reassign(points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, full scans) of the points after their centroids have moved; without ``moved`` all are scanned."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    doubtful = np.arange(len(points))
    if moved is not None and len(centroids) > 1:
        upper += moved[0][cluster]
        lower -= moved[1][cluster]
        between = np.sqrt(distances(centroids, centroids).astype(np.float64)) * (1 - SLACK)
        np.fill_diagonal(between, np.inf)
        limit = np.maximum(lower, between.min(axis=1)[cluster] / 2)
        doubtful = np.flatnonzero(upper >= limit)
        own = ((points[doubtful] - centroids[cluster[doubtful]]) ** 2).sum(axis=1)
        upper[doubtful] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
        doubtful = doubtful[upper[doubtful] >= limit[doubtful]]
    if len(doubtful):
        far = distances(points[doubtful], centroids)
        best = far.argmin(axis=1)  # of equal distances the first: the smaller number
        line = np.arange(len(doubtful))
        cluster[doubtful] = best
        upper[doubtful] = np.sqrt(far[line, best].astype(np.float64)) * (1 + SLACK)
        far[line, best] = np.iinfo(np.int64).max
        lower[doubtful] = np.sqrt(far.min(axis=1).astype(np.float64)) * (1 - SLACK)
    return cluster, upper, lower, len(doubtful)


STATE = "vec_id long, v array<long>, cluster int, upper double, lower double, distance long"


def _assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, tally) -> DataFrame:  # noqa: ANN001
    """The state after one assignment; ``before`` are the centroids of the assignment before, if there was one."""
    shared = state.sparkSession.sparkContext.broadcast((centroids, None if before is None else drifts(before, centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, moved = shared.value
        scans = 0
        for batch in batches:
            points = np.asarray(batch.column(1).flatten(), np.int64).reshape(batch.num_rows, centres.shape[1])
            held = [np.asarray(batch.column(c)) for c in (2, 3, 4)]
            cluster, upper, lower, n = reassign(points, *held, centres, moved)
            scans += n
            distance = ((points - centres[cluster]) ** 2).sum(axis=1)
            columns = [pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["vec_id", "v", "cluster", "upper", "lower", "distance"])
        if tally is not None:
            tally.add(scans)

    return materialize(state.mapInArrow(run, STATE))


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors, by component; an empty cluster keeps its centroid. One row a cluster reaches the driver."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [total // row["n"] for total in row[2:]]
    return out


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, tally=None) -> DataFrame:  # noqa: ANN001
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    ``embeddings``: vec_id, embedding. Vectors of exactly ``size`` components, none null or not finite, become whole numbers
    floor(scale * x). Others take no part, nor do rows without id and vectors whose whole numbers have a squared norm of 2^60 or
    more (their distances need not fit 64 bits). The first centroids are the vectors of the k smallest SHA-256 of ``1:<vec_id>``; with fewer
    vectors there are fewer centroids. Each of ``rounds`` rounds assigns all vectors to the nearest centroid (ties: the smaller number) and
    moves each non-empty cluster's centroid to the floor of its mean; a last assignment follows. Rows that repeat an id are
    vectors of their own, in the result too. Empty tables give empty results; further columns are ignored.

    A round is one pass over the table of bounds, written again, and one aggregate with a row for each cluster and task; only the centroids,
    k x size numbers, are broadcast. ``tally``, an accumulator, gets the number of full scans.
    """
    spark = embeddings.sparkSession
    wide = only(embeddings, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") == size))
    whole = wide.select(F.col("vec_id").cast("long").alias("vec_id"), whole_vector(F.col("embedding"), scale).alias("v")).where("v is not null")
    since = written()
    state = materialize(whole.withColumns({"cluster": F.lit(0), "upper": F.lit(0.0), "lower": F.lit(0.0), "distance": F.lit(0).cast("long")}))
    centroids, before = seeds(state, k), None
    if not len(centroids):
        release(spark, since)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for turn in range(rounds + 1):
        state = _assigned(state, centroids, before, tally)
        release(spark, since, keep_last=True)
        if turn < rounds:
            before, centroids = centroids, moved_centroids(state, centroids)
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    inertia = sum(r[1] for r in sums)
    facts = [(r[0], r[1], inertia, hashlib.sha256(",".join(map(str, centroids[r[0]].tolist())).encode()).hexdigest()) for r in sums]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return settled(state.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster"), since).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
