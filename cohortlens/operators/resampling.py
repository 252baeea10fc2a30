"""Bootstrap intervals, random-ranking and sign-flip tests from counter-based draws.

Draw number = iteration * n + position, so every draw is a function of its index and iterations are
independent rows: no sequential state, any partitioning gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import counter_uniform_at
from ..storage import materialize
from .ranking import running_total


def _numbered(values: DataFrame, order: str, value: str) -> tuple[np.ndarray, bool]:
    """The values in the order of a key, and whether one is null; the frame is a ranking of families, bounded by the caller."""
    packed = values.agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(value).alias("v")))).alias("a")).select(F.transform("a", lambda x: x["v"]).alias("vs"))
    vs = packed.first()["vs"]
    return np.array(vs, float), None in vs


def _drawn(spark: SparkSession, vs: np.ndarray, gaps: bool, seed: int, iterations: int, take: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """(iteration, mean, recall): the mean over all positions of what ``take`` makes of a draw there, and the share of 0.9 and more.

    Iterations are dealt over tasks; positions are added one after another, for many iterations at once, so sums are those of a loop.
    """
    n = len(vs)
    if not n:
        return spark.range(0).select(F.col("id").alias("iteration"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("recall"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_numpy()
            total, hits = np.zeros(len(some)), np.zeros(len(some), np.int64)
            for j in range(n):
                x = take(counter_uniform_at(seed, some * n + j), j)
                total += x
                hits += x >= 0.9
            mean = total / n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean, mask=np.isnan(mean) if gaps else None), pa.array(hits / n)], ["iteration", "mean", "recall"])

    tasks = max(1, min(iterations, -(-iterations * n // FEW_DRAWS)))
    return spark.range(0, iterations, 1, tasks).withColumnRenamed("id", "iteration").mapInArrow(draw, "iteration long, mean double, recall double")


def bootstrap_means(values: DataFrame, order: str, value: str, seed: int, iterations: int) -> DataFrame:
    """(iteration, mean, recall): means of n draws with replacement and their share of values of 0.9 and more."""
    vs, gaps = _numbered(values, order, value)
    return _drawn(values.sparkSession, vs, gaps, seed, iterations, lambda u, j: vs[np.floor(u * len(vs)).astype(np.int64)])


def bootstrap_interval(values: DataFrame, order: str, value: str, seed: int = 0x54C043, iterations: int = 4000) -> DataFrame:
    """One row: percentile intervals of the mean and of the recall at 10 percent."""
    means = bootstrap_means(values, order, value, seed, iterations)
    return means.agg(
        F.percentile("mean", 0.025).alias("mean_low"), F.percentile("mean", 0.975).alias("mean_high"),
        F.percentile("recall", 0.025).alias("recall_low"), F.percentile("recall", 0.975).alias("recall_high"),
    )


#: Draws that a task makes at a time, draws of one piece of a family, and draws of one task, about.
DRAWS, PIECE, TASK_DRAWS = 1 << 20, 1 << 16, 1 << 27
#: The same of a task that bootstraps or flips.
FEW_DRAWS = 1 << 23


def random_ranking_test(counts: DataFrame, order: str, count: str, observed_mean: float, observed_hits: int, seed: int = 0x50A17E, iterations: int = 10_000) -> DataFrame:
    """One row: p-values that families of the given marker counts, each the mean of that many uniform draws, do as well.

    Families are in the order of their key; a running total gives the number of a family's first draw. Families are dealt over tasks,
    large ones in pieces, and each task adds up its families' means and hits by iteration: one row an iteration and task. No row
    meets each iteration and nothing of a family's size is held.
    """
    spark = counts.sparkSession
    rows = counts.select(F.col(order).alias("key"), F.col(count).cast("long").alias("size"))
    n, m = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([(1.0, 1.0)], "p_mean double, p_recall double")
    numbered = materialize(running_total(rows, ["key"], "size", "first").withColumn("family", F.monotonically_increasing_id()))
    steps = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / PIECE) - 1)
    pieces = numbered.where("size > 0").select("family", "size", "first", F.explode(steps).alias("piece"))
    pieces = pieces.select("family", "size", (F.col("first") + F.col("piece") * PIECE).alias("first"), F.least(F.lit(PIECE).cast("long"), F.col("size") - F.col("piece") * PIECE).alias("length"))
    tasks = max(1, min(-(-iterations * m // TASK_DRAWS), n * (1 + m // PIECE)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hits = np.zeros(iterations), np.zeros(iterations, np.int64)
        names = ["iteration", "family", "size", "total", "hits"]
        for batch in batches:
            family, size, first, length = (np.asarray(c) for c in batch.columns)
            for begin, end in _bounded(length, DRAWS):
                own = length[begin:end]
                ends = np.cumsum(own)
                starts = ends - own
                at = np.repeat(first[begin:end] - starts, own) + np.arange(ends[-1])
                whole = own == size[begin:end]
                step = max(1, DRAWS // len(at))
                for i in range(0, iterations, step):
                    some = np.arange(i, min(i + step, iterations))
                    sums = np.add.reduceat(counter_uniform_at(seed, some[:, None] * m + at[None, :]), starts, axis=1)
                    means = sums[:, whole] / own[whole]
                    total[some] += means.sum(axis=1)
                    hits[some] += (means >= 0.9).sum(axis=1)
                    for j in np.flatnonzero(~whole).tolist():
                        k = len(some)
                        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(k, family[begin + j])), pa.array(np.full(k, size[begin + j])), pa.array(sums[:, j]), pa.array(np.zeros(k, np.int64))], names)
        none = pa.nulls(iterations, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations)), none, none, pa.array(total), pa.array(hits)], names)

    dealt = pieces.repartition(tasks, F.xxhash64("first"))
    drawn = materialize(dealt.mapInArrow(draw, "iteration long, family long, size long, total double, hits long"))
    large = drawn.where("family is not null").groupBy("iteration", "family").agg((F.sum("total") / F.first("size")).alias("total"))
    large = large.select("iteration", "total", (F.col("total") >= 0.9).cast("long").alias("hits"))
    each = drawn.where("family is null").select("iteration", "total", "hits").unionByName(large).groupBy("iteration").agg((F.sum("total") / n).alias("mean"), F.sum("hits").alias("hits"))
    return each.agg(
        ((F.count_if(F.col("mean") >= observed_mean) + 1) / (iterations + 1)).alias("p_mean"), ((F.count_if(F.col("hits") >= observed_hits) + 1) / (iterations + 1)).alias("p_recall")
    )


def _bounded(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` in all, or one row."""
    ends, begin = np.cumsum(lengths), 0
    while begin < len(lengths):
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right"))
        end = max(end, begin + 1)
        yield begin, end
        begin = end


def paired_comparison(deltas: DataFrame, order: str, delta: str, bootstrap_seed: int, flip_seed: int, bootstraps: int = 4000, flips: int = 10_000) -> DataFrame:
    """One row: mean paired difference, its bootstrap interval, two-sided sign-flip p-value, and families improved, tied and worsened."""
    vs, gaps = _numbered(deltas, order, delta)
    boot = bootstrap_means(deltas, order, delta, bootstrap_seed, bootstraps).agg(F.percentile("mean", 0.025).alias("ci_low"), F.percentile("mean", 0.975).alias("ci_high"))
    observed = abs(float(np.cumsum(vs)[-1] / len(vs))) if len(vs) else 0.0  # one after another, as the draws
    flipped = _drawn(deltas.sparkSession, vs, gaps, flip_seed, flips, lambda u, j: np.where(u < 0.5, vs[j], -vs[j]))
    p = flipped.agg(((F.count_if(F.abs("mean") >= observed) + 1) / (flips + 1)).alias("p_value"))
    x = F.col(delta)
    counts = deltas.agg(F.avg(x).alias("mean_delta"), F.count_if(x > 1e-12).alias("improved"), F.count_if(F.abs(x) <= 1e-12).alias("tied"), F.count_if(x < -1e-12).alias("worsened"))
    return counts.join(F.broadcast(boot)).join(F.broadcast(p))
