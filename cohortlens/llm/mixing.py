"""Mixing documents to target domain weights through soft memberships.

A classifier trained on a labelled table gives each document posteriors over domains. Nonnegative rates, one for each
document, are fitted so that the expected tokens of each domain (rate x tokens x posterior,
summed over all documents) match targets: least squares by projected gradient steps, whose sums
over the documents are distributed aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear_text
from .common import SLICE, held_by, materialize, only, slices, utf8

#: Posteriors are rounded to this many places; documents of equal posteriors have equal rates.
PLACES = 4
STEPS = 100
#: A fit ends when every domain is this near its target share.
TOLERANCE = 1e-5
#: Weight of the pull of rates towards 1, which makes the fit unique.
PULL = 1e-4


def fit_domains(documents: DataFrame, labels: DataFrame, label: str, max_rows: int = 4000) -> linear_text.LinearText | None:
    """A domain classifier from ``labels`` (doc_id, ``label``), on at most ``max_rows`` labelled documents. Case and punctuation count."""
    marked = only(labels, "doc_id", label).withColumnRenamed(label, "label")
    return linear_text.fit_labelled(documents, marked, max_rows, sizes=(3, 4), bits=18, fold=False, ridge=1e-3)


def word_counts(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """How many runs of bytes other than space and \\t\\n\\v\\f\\r each row has; a long text is read in pieces."""
    data, at = utf8(batch, column)
    out = np.zeros(batch.num_rows, np.int64)
    some = np.flatnonzero(np.diff(at) > 0)
    for p in range(0, len(data), SLICE):
        part = data[max(0, p - 1) : p + SLICE]  # with the byte before
        gap = (part == 32) | ((part >= 9) & (part <= 13))
        begins = ~gap
        begins[1:] &= gap[:-1]
        starts = at[some][(at[some] >= p) & (at[some] < p + SLICE)] - max(0, p - 1)
        begins[starts] = ~gap[starts]
        if p:
            begins[0] = False
        at_begins = np.flatnonzero(begins) + max(0, p - 1)
        out += np.bincount(np.searchsorted(at, at_begins, side="right") - 1, minlength=batch.num_rows)
    return out


def score_domains(documents: DataFrame, model: linear_text.LinearText | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, ``tokens`` (words of the text) and ``posteriors`` in the order of the model's labels."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    plain = documents.toDF(*(f"c{i}" for i in range(len(names))))
    at = f"c{names.index(text)}"
    kept = [f"c{names.index(k)}" for k in keep]
    schema = T.StructType([*(plain.schema[k] for k in kept), T.StructField("tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, at):
                p = model.posteriors(part, at) if model else np.zeros((part.num_rows, 0))
                if p.shape[1]:
                    p = p.round(PLACES)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * p.shape[1], pa.int32()), pa.array(p.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*(held_by(part, k) for k in kept), pa.array(word_counts(part, at), pa.int64()), lists], [*kept, "tokens", "posteriors"])

    return plain.mapInArrow(run, schema).toDF(*keep, "tokens", "posteriors")


def fit_rates(scored: DataFrame, targets: list[float], budget: float | None = None) -> tuple[list[list[float]], list[float]]:
    """The steps' directions, for :func:`rate_of`, and the token shares of the domains that the rates reach.

    ``scored`` has ``tokens`` and ``posteriors``; ``targets`` are the wanted shares of ``budget`` tokens (default: all there are).
    With w the documents' shares of tokens and a the sums of w x rate x posterior, the loss is
    half of (a - target)' M (a - target) plus PULL/2 x the w-weighted squared distance of the rates from 1. M, the inverse of the
    sums of w x posterior x posterior' (plus a little), makes all directions equally steep: a step of
    projected gradient descent subtracts posterior' M (a - target) from each rate and cuts at 0, and unit steps are safe.

    A document's rate depends on its posteriors and the directions alone, so directions are all that is kept;
    documents of equal posteriors are one row of the aggregates.
    """
    cells = materialize(scored.where("tokens > 0").groupBy("posteriors").agg(F.sum("tokens").alias("tokens")))
    total = cells.agg(F.sum("tokens")).first()[0]
    d = len(targets)
    if not total or not d:
        return [], []
    weighted = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    p = [F.element_at("posteriors", k + 1) for k in range(d)]
    spread = weighted.agg(*(F.sum(F.col("w") * p[i] * p[j]) for i in range(d) for j in range(d))).first()
    metric = np.linalg.inv(np.array(spread).reshape(d, d) + 1e-9 * np.eye(d))
    goal = np.array(targets) / sum(targets) * ((budget or total) / total)
    steps: list[list[float]] = []
    while True:
        rates = rate_of(F.col("posteriors"), steps)
        reached = np.array(weighted.select("w", "posteriors", rates.alias("r")).agg(*(F.sum(F.col("w") * F.col("r") * p[k]) for k in range(d))).first())
        gap = reached - goal
        direction = metric @ gap
        still = bool(steps) and np.abs(direction - steps[-1]).max() < 1e-9  # what is left is out of reach
        if np.abs(gap).max() < TOLERANCE or still or len(steps) == STEPS:
            return steps, (reached / max(reached.sum(), 1e-12)).tolist()
        steps.append(direction.tolist())


def rate_of(posteriors: Column, steps: list[list[float]]) -> Column:
    """The rate of a document: all steps so far, from 1, replayed on its posteriors."""
    if not steps:
        return F.lit(1.0)

    def step(rate: Column, direction: Column) -> Column:
        slope = F.aggregate(F.zip_with(direction, posteriors, lambda g, p: g * p), F.lit(0.0), lambda a, b: a + b)
        return F.greatest(F.lit(0.0), rate - (slope + PULL * (rate - 1)) / (1 + PULL))

    return F.aggregate(F.array(*(F.array(*map(F.lit, g)) for g in steps)), F.lit(1.0), step)


def mix(documents: DataFrame, model: linear_text.LinearText | None, targets: dict[int, float], keep: list[str], seed: int = 0, key: str = "doc_id") -> DataFrame:
    """The columns ``keep``, tokens, posteriors, rate and copies of every row.

    ``targets`` are the wanted token shares of the model's labels (a label without one is wanted at 0; the model knows no
    others). ``copies`` is the rate rounded up or down by the hash of the key and ``seed``, right on average. Null and empty texts have
    no tokens: their rate follows their posteriors like any other. Without a model every rate is 1. Repeated rows get equal
    rates; an empty table gives an empty result.
    """
    scored = materialize(score_domains(documents, model, keep))
    wanted = [float(targets.get(k, 0.0)) for k in model.labels] if model else []
    steps = fit_rates(scored, wanted)[0] if any(wanted) else []
    rated = scored.withColumn("rate", F.round(rate_of(F.col("posteriors"), steps), 6))
    chance = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return rated.withColumn("copies", F.floor(F.col("rate") + chance))
