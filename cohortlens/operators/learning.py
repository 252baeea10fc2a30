"""Model fits: batch-gradient and Newton logistic regressions, positive-unlabelled ensembles, nested validation.

Batch gradients and Newton steps are sums over rows where they lie. The fits of ensembles learn from a bounded number of sequences; they are independent
work items, dealt over the cluster as groups of a frame and run in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import CongruentialDraws, fnv1a, fnv1a_np, fnv1a_py
from ..llm.common import WORKER_ENVIRONMENT
from ..storage import large_rows, materialize
from .ranking import auc, benjamini_hochberg, global_rank, hash_bags
from .resampling import bootstrap_interval, paired_comparison


def sigmoid(z: np.ndarray) -> np.ndarray:
    """Exactly 0 and 1 beyond 35."""
    return np.where(z < -35, 0.0, np.where(z > 35, 1.0, 1 / (1 + np.exp(-np.clip(z, -35, 35)))))


# --- historical batch models --------------------------------------------------------------------


def stratified_split(keys: list[tuple[object, int]], share: float = 0.2, seed: int = 42) -> dict[object, str]:
    """key -> train or test: the first share of each class after a shuffle, classes in order of first appearance, one stream of draws."""
    draws, out = CongruentialDraws(seed), {}
    by: dict[int, list] = {}
    for key, label in keys:
        by.setdefault(label, []).append(key)
    for members in by.values():
        draws.shuffle(members)
        cut = round(len(members) * share)
        out.update({k: "test" if i < cut else "train" for i, k in enumerate(members)})
    return out


def split_frame(rows: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """(key, label, split): :func:`stratified_split` of the rows in order of their key, without collecting keys; keys are unique.

    Keys are ranked within their class by ranges. The shuffle of a class is one stream of draws by definition: a task for each class runs it
    over places, not rows, starting where the classes before end, and returns the places that are test rows.
    """
    spark = rows.sparkSession
    ranked = materialize(global_rank(rows.select(key, label), [F.col(label), F.col(key)], "_r"))
    sizes = ranked.groupBy(label).agg(F.min("_r").alias("_first"), F.count("*").alias("_n"), F.min(key).alias("_key"))
    facts = sizes.orderBy("_key").collect()  # a row a class
    if not facts:
        return rows.select(key, label, F.lit("").alias("split"))
    before = np.cumsum([0, *(max(0, r["_n"] - 1) for r in facts)])
    classes = [(int(r["_first"]), int(r["_n"]), int(b)) for r, b in zip(facts, before, strict=False)]

    def shuffled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for first, n, skip in pdf.itertuples(index=False):
                places = CongruentialDraws(seed).skip(skip).shuffle(list(range(n)))[: round(n * share)]
                for begin in range(0, len(places), 100_000):
                    yield pd.DataFrame({"_r": np.array(places[begin : begin + 100_000], np.int64) + first})

    test = spark.createDataFrame(classes, "first long, n long, skip long").repartition(len(classes), "first").mapInPandas(shuffled, "_r long")
    return ranked.join(test.withColumn("split", F.lit("test")), "_r", "left").select(key, label, F.coalesce("split", F.lit("train")).alias("split"))


def gradient_logistic(x: np.ndarray, y: np.ndarray, epochs: int = 1800, rate: float = 0.035, l2: float = 0.001) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with a fixed number of epochs, not to convergence; the bias has no penalty."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        e = sigmoid(x @ w + b) - y
        w, b = w - rate * (x.T @ e / len(y) + l2 * w), b - rate * e.mean()
    return w, float(b)


class GradientBlock:
    """Rows of the standardised training matrix, and what they add to a step."""

    def __init__(self, batches: Iterator[pa.RecordBatch], mean: np.ndarray, sd: np.ndarray):
        parts = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float) for b in batches if b.num_rows]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(mean) + 1))
        self.x, self.y = (rows[:, :-1] - mean) / sd, rows[:, -1]

    def partial(self, weights: np.ndarray) -> np.ndarray:
        """Sums of the gradient by the weights and, last, by the bias."""
        e = sigmoid(self.x @ weights[:-1] + weights[-1]) - self.y
        return np.r_[self.x.T @ e, e.sum()]


def descended(weights: np.ndarray, total: np.ndarray, n: int, rate: float, l2: float) -> np.ndarray:
    """The weights, the bias last, after one step; the bias has no penalty."""
    return weights - rate * (total / n + l2 * np.r_[weights[:-1], 0.0])


#: Bytes of a training matrix up to which one task holds it for all epochs.
HELD_BYTES = 256 << 20


def fit_gradient_logistic(wide: DataFrame, features: list[str], label: str, epochs: int = 1800, rate: float = 0.035, l2: float = 0.001, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(feature, mean, sd, weight, bias) of a standardised full-batch fit with a fixed number of epochs, as :func:`gradient_logistic` makes it.

    Rows with a null or not finite cell take no part. An epoch needs the gradient of all rows. A matrix of more than ``held_bytes`` is dealt over the
    slots and stored; every epoch is one job in which each task adds up its rows' gradient, a row a task, and the driver takes the step. A
    smaller one is read by one task that takes all steps, since a job an epoch would cost more than the epoch. Both give the same weights.
    """
    spark = wide.sparkSession
    rows = wide.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate([*features, label])))
    for c in rows.columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = materialize(rows)
    moments = rows.agg(F.count("*"), *(f(c) for c in rows.columns[:-1] for f in (F.avg, F.stddev_samp))).first()
    n, schema = moments[0], "feature string, mean double, sd double, weight double, bias double"
    if not n:
        return spark.createDataFrame([], schema)
    mean = np.array(moments[1::2], float)
    sd = np.array([x if x is not None and x > 0 else 1.0 for x in moments[2::2]], float)
    zero = np.zeros(len(features) + 1)
    if 8 * n * (len(features) + 1) <= held_bytes:

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, weights = GradientBlock(batches, mean, sd), zero
            for _ in range(epochs):
                weights = descended(weights, block.partial(weights), n, rate, l2)
            yield pa.RecordBatch.from_pydict({"w": weights})

        weights = np.array([r["w"] for r in rows.coalesce(1).mapInArrow(descend, "w double").collect()])  # one for each feature
    else:
        dealt, weights = materialize(rows.repartition(spark.sparkContext.defaultParallelism)), zero
        for _ in range(epochs):
            now = weights

            def step(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
                total = zero.copy()
                for batch in batches:
                    total += GradientBlock(iter([batch]), mean, sd).partial(now)
                yield pa.RecordBatch.from_pydict({"g": [total.tobytes()]})

            parts = [np.frombuffer(r["g"]) for r in dealt.mapInArrow(step, "g binary").collect()]  # a row a task
            weights = descended(weights, np.sum(parts, axis=0), n, rate, l2)
    model = zip(features, mean.tolist(), sd.tolist(), weights[:-1].tolist(), strict=True)
    return spark.createDataFrame([(*m, float(weights[-1])) for m in model], schema)


def score(wide: DataFrame, model: dict, threshold: float | None = None) -> DataFrame:
    """Adds ``probability`` (6 places) and ``predicted`` from a model of features, means, stds, weights and bias: one row-local expression, also on streams."""
    z: Column = F.lit(float(model["bias"]))
    for name, mean, sd, w in zip(model["features"], model["means"], model["stds"], model["weights"], strict=True):
        value = F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(0.0)), F.lit(0.0))))
        z = z + F.lit(float(w)) * (value - float(mean)) / float(sd or 1)
    p = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    cut = model.get("threshold", 0.5) if threshold is None else threshold
    return wide.withColumn("probability", F.round(p, 6)).withColumn("predicted", (p >= cut).cast("int"))


# --- one feature at a time ----------------------------------------------------------------------


def newton_logistic(values: np.ndarray, y: np.ndarray, l2: float = 0.01, iterations: int = 50, tolerance: float = 1e-8) -> tuple[float, float, float, float]:
    """(weight, bias, center, scale) of a standardised univariate fit with penalty l2/2 * n * weight^2."""
    center = values.mean()
    scale = values.std(ddof=1) if len(values) > 1 else 0.0
    scale = scale if scale > 0 else 1.0
    x, w, b, penalty = (values - center) / scale, 0.0, 0.0, l2 * max(1, len(values))
    for _ in range(iterations):
        p = sigmoid(w * x + b)
        e, c = p - y, p * (1 - p)
        gw, gb = float(e @ x) + penalty * w, float(e.sum())
        hww, hbb, hwb = penalty + float(c @ (x * x)), float(c.sum()), float(c @ x)
        det = hww * hbb - hwb * hwb
        if not np.isfinite(det) or abs(det) < 1e-12:
            break
        dw, db = (hbb * gw - hwb * gb) / det, (hww * gb - hwb * gw) / det
        w, b = w - dw, b - db
        if max(abs(dw), abs(db)) < tolerance:
            break
    return w, b, float(center), float(scale)


def tie_auc(scores: np.ndarray, y: np.ndarray) -> float:
    ranks = pd.Series(scores).rank(method="average").to_numpy()
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * n0))


def _probability(z: Column) -> Column:
    return F.when(z < -35, 0.0).when(z > 35, 1.0).otherwise(1 / (1 + F.exp(-z)))


def newton_fits(rows: DataFrame, models: DataFrame, l2: float = 0.01, iterations: int = 50, tolerance: float = 1e-8, few: int = 200_000) -> DataFrame:
    """(feature, k, n, center, scale, weight, bias) of univariate fits, all at once.

    ``rows`` is (feature, y, fold, value), ``models`` (feature, k): a model of ``k`` learns from the rows of its feature in other folds, of all where ``k`` is
    null. Each iteration is one aggregate of gradients and Hessians by model; models that have converged leave it. Up to ``few`` models are broadcast
    to the rows, more are joined by the feature.
    """
    def met(some: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(some) if some.count() <= few else some, "feature").where("k is null or k <> fold")

    first = met(models).groupBy("feature", "k").agg(F.count("*").alias("n"), F.avg("value").alias("center"), F.stddev_samp("value").alias("scale"))
    start = {"scale": F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0), "weight": F.lit(0.0), "bias": F.lit(0.0), "active": F.lit(True)}
    fits = materialize(first.withColumns(start))
    x = (F.col("value") - F.col("center")) / F.col("scale")
    state = ["n", "center", "scale", "weight", "bias"]
    for _ in range(iterations):
        active = fits.where("active")
        if active.isEmpty():
            break
        at = met(active).withColumn("x", x).withColumn("p", _probability(F.col("weight") * F.col("x") + F.col("bias")))
        at = at.withColumn("e", F.col("p") - F.col("y")).withColumn("c", F.col("p") * (1 - F.col("p")))
        sums = at.groupBy("feature", "k").agg(
            *(F.first(s).alias(s) for s in state), F.sum(F.col("e") * F.col("x")).alias("gw"), F.sum("e").alias("gb"),
            F.sum(F.col("c") * F.col("x") * F.col("x")).alias("ww"), F.sum("c").alias("bb"), F.sum(F.col("c") * F.col("x")).alias("wb"),
        )
        penalty = l2 * F.greatest(F.lit(1), F.col("n"))
        sums = sums.withColumns({"gw": F.col("gw") + penalty * F.col("weight"), "ww": F.col("ww") + penalty})
        det = F.col("ww") * F.col("bb") - F.col("wb") * F.col("wb")
        usable = F.coalesce((F.abs(det) >= 1e-12) & (F.abs(det) < float("inf")), F.lit(False)) & ~F.isnan(det)
        step = lambda a, b: F.when(usable, (a * F.col("gw") - b * F.col("gb")) / F.when(usable, det)).otherwise(0.0)
        moved = sums.withColumns({"dw": step(F.col("bb"), F.col("wb")), "db": step(-F.col("wb"), -F.col("ww")), "usable": usable})
        moved = moved.withColumns({"weight": F.col("weight") - F.col("dw"), "bias": F.col("bias") - F.col("db"), "active": F.col("usable") & (F.greatest(F.abs("dw"), F.abs("db")) >= tolerance)})
        fits = materialize(fits.where("not active").unionByName(moved.select("feature", "k", *state, "active")))
    return fits.select("feature", "k", *state)


def cross_validated_newton(long: DataFrame, feature: str = "feature", label: str = "label", fold: str = "fold", value: str = "value") -> DataFrame:
    """Per feature: the full fit's weight and bias, and out-of-fold AUC, accuracy, F1 and prediction count.

    Fit per distinct feature set, not per candidate that shares it. No task holds a feature's column: fits are aggregates (:func:`newton_fits`) and the AUC
    comes from counts. A fold in which a feature lacks a class is an error.
    """
    rows = materialize(long.select(F.col(feature).alias("feature"), F.col(label).cast("double").alias("y"), F.col(fold).alias("fold"), F.col(value).cast("double").alias("value")))
    held = rows.groupBy("feature", "fold").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    held = materialize(held)
    if bad := held.where("n1 = 0 or n0 = 0").first():
        raise ValueError(f"fold {bad['fold']} lacks a class")
    models = held.select("feature", F.col("fold").alias("k"))
    models = models.unionByName(held.select("feature").distinct().withColumn("k", F.lit(None).cast(held.schema["fold"].dataType)))
    fits = newton_fits(rows, materialize(models))
    out = fits.where("k is not null").select("feature", F.col("k").alias("fold"), "center", "scale", "weight", "bias")
    small = out.count() <= 200_000
    z = F.col("weight") * (F.col("value") - F.col("center")) / F.col("scale") + F.col("bias")
    scored = materialize(rows.join(F.broadcast(out) if small else out, ["feature", "fold"]).select("feature", "y", _probability(z).alias("p")))
    hit, true = F.col("p") >= 0.5, F.col("y") == 1
    tp, fp, fn = F.count_if(hit & true), F.count_if(hit & ~true), F.count_if(~hit & true)
    rates = scored.groupBy("feature").agg(
        F.avg((hit == true).cast("double")).alias("cv_accuracy"), (2 * tp / F.greatest(F.lit(1), 2 * tp + fp + fn)).cast("double").alias("cv_f1"), F.count("*").alias("n")
    )
    areas = auc(scored, ["feature"], "y", "p").select("feature", F.col("auc").alias("cv_auc"))
    full = fits.where("k is null").select("feature", "weight", "bias", "center", "scale")
    return full.join(areas, "feature").join(rates, "feature").select("feature", "weight", "bias", "center", "scale", "cv_auc", "cv_accuracy", "cv_f1", "n")


# --- positive-unlabelled ensembles ----------------------------------------------------------------


#: Positives that a fit learns from at most, those with the smallest hashes: the default of a parameter. All are scored.
MAX_POSITIVES = 500
RANKED = "name string, score double, oob_models int, fallback boolean, median double, q25 double, q75 double, top_1 double, top_5 double, top_10 double, top_20 double, features array<string>"

#: The configurations that selection chooses from, as (id, k-mer sizes, blocks, L2, L1, weight of unlabelled to positive, least presence), and those
#: of the ablation, in which only the block changes. Ids are part of salts and of ties. Fixed values.
CONFIGS = (
    ("k234_core_mature_l2_003_u050", (2, 3, 4), "core", 0.03, 0.0, 0.5, 2.0),
    ("k234_composition_mature_l2_003_u050", (2, 3, 4), "composition", 0.03, 0.0, 0.5, 2.0),
    ("k234_positional_mature_l2_003_u050", (2, 3, 4), "positional", 0.03, 0.0, 0.5, 2.0),
    ("k234_terminals_mature_l2_003_u050", (2, 3, 4), "terminals", 0.03, 0.0, 0.5, 2.0),
    ("k234_full_mature_l2_003_u050", (2, 3, 4), "full", 0.03, 0.0, 0.5, 2.0),
    ("k234_full_mature_elastic_l1_001", (2, 3, 4), "full", 0.03, 0.01, 0.5, 2.0),
    ("k2345_full_mature_l2_003_u050", (2, 3, 4, 5), "full", 0.03, 0.0, 0.5, 2.0),
    ("k234567_full_mature_elastic_l1_001", (2, 3, 4, 5, 6, 7), "full", 0.05, 0.01, 0.4, 2.0),
)
ABLATIONS = (
    ("ablation_k234_core", (2, 3, 4), "core", 0.03, 0.0, 0.5, 2.0),
    ("ablation_k234_composition", (2, 3, 4), "composition", 0.03, 0.0, 0.5, 2.0),
    ("ablation_k234_positional", (2, 3, 4), "positional", 0.03, 0.0, 0.5, 2.0),
    ("ablation_k234_terminals", (2, 3, 4), "terminals", 0.03, 0.0, 0.5, 2.0),
    ("ablation_k234_full", (2, 3, 4), "full", 0.03, 0.0, 0.5, 2.0),
)


def sequence_features(s: str, sizes: tuple[int, ...], blocks: str) -> dict[str, float]:
    """The features of one sequence, as :func:`operators.sequences.feature_vectors` makes them for frames."""
    out: dict[str, float] = {}
    for k in sizes:
        for i in range(len(s) - k + 1):
            out[s[i : i + k]] = out.get(s[i : i + k], 0.0) + 1
    out["seed:" + s[1:8]] = 2.0
    total = sum(out.values())
    out = {f: v / total for f, v in out.items()}
    n = max(1, len(s))
    share = {b: s.count(b) / n for b in "ACGU"}
    out["composition:length"], out["composition:gc"] = min(1.0, len(s) / 30), share["G"] + share["C"]
    if blocks in ("composition", "full"):
        out |= {f"composition:base_{b}": p for b, p in share.items()}
        out["composition:entropy"] = -sum(p * np.log2(p) for p in share.values() if p > 0) / 2
    if blocks in ("positional", "full"):
        tags: dict[str, float] = {}
        for k in (k for k in sizes if k <= 4):
            for i in range(len(s) - k + 1):
                middle = (i + k / 2) / n
                tag = f"positional:{'5p' if middle < 1 / 3 else 'center' if middle < 2 / 3 else '3p'}:{s[i : i + k]}"
                tags[tag] = tags.get(tag, 0.0) + 1
        held = sum(tags.values())
        out |= {f: v / held for f, v in tags.items()}
    if blocks in ("terminals", "full"):
        for k in (2, 3, 4):
            if len(s) >= k:
                out[f"terminal:5p:{k}:{s[:k]}"] = out[f"terminal:3p:{k}:{s[-k:]}"] = 0.25
    return out


REGIONS, ENDS = ("5p", "center", "3p"), ("5p", "3p")
CODES = np.full(256, 4, np.int64)
CODES[np.frombuffer(b"ACGU", np.uint8)] = range(4)


@lru_cache
def feature_columns(sizes: tuple[int, ...], blocks: str) -> dict[str, int]:
    """The columns of :func:`dense_features` by name."""
    of = {k: ["".join(p) for p in product("ACGU", repeat=k)] for k in {*sizes, 2, 3, 4}}
    out = [m for k in sizes for m in of[k]] + ["composition:length", "composition:gc"]
    if blocks in ("composition", "full"):
        out += [f"composition:base_{b}" for b in "ACGU"] + ["composition:entropy"]
    if blocks in ("positional", "full"):
        out += [f"positional:{r}:{m}" for k in sizes if k <= 4 for r in REGIONS for m in of[k]]
    if blocks in ("terminals", "full"):
        out += [f"terminal:{e}:{k}:{m}" for k in (2, 3, 4) for e in ENDS for m in of[k]]
    return {f: i for i, f in enumerate(out)}


#: Letters whose features are made together, about.
LETTERS = 1 << 19


def dense_features(sequences: list[str], sizes: tuple[int, ...], blocks: str) -> tuple[np.ndarray, np.ndarray]:
    """:func:`sequence_features` of sequences of A, C, G and U as rows of a matrix, and the value of each one's seed.

    The letters of many sequences are looked at together; a k-mer that would reach into the next sequence is none.
    """
    x, mass = np.zeros((len(sequences), len(feature_columns(sizes, blocks)))), np.zeros(len(sequences))
    ends, begin = np.cumsum([len(s) for s in sequences]), 0
    while begin < len(sequences):
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + LETTERS, side="right"))
        end = max(end, begin + 1)
        mass[begin:end] = _fill_features(sequences[begin:end], sizes, blocks, x[begin:end])
        begin = end
    return x, mass


def _fill_features(sequences: list[str], sizes: tuple[int, ...], blocks: str, x: np.ndarray) -> np.ndarray:
    letters = CODES[np.frombuffer("".join(sequences).encode("ascii", "replace"), np.uint8)]
    if len(letters) and letters.max() > 3:
        raise ValueError("a sequence has letters besides A, C, G and U")
    m, n = len(sequences), np.array([len(s) for s in sequences], np.int64)
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(m), n)
    place = np.arange(len(letters)) - np.repeat(first, n)
    left = np.repeat(n, n) - place
    codes, code = {1: (row, letters, place)}, letters
    plain = {1: letters}
    for k in range(2, max(4, *sizes) + 1):
        code = code[: max(0, len(letters) - k + 1)] * 4 + letters[k - 1 :]
        own = np.flatnonzero(left[: len(code)] >= k)
        codes[k], plain[k] = (row[own], code[own], place[own]), code
    counts = lambda k, kinds=1, kind=0: np.bincount((codes[k][0] * kinds + kind) * 4**k + codes[k][1], minlength=m * kinds * 4**k).reshape(m, kinds * 4**k)
    many = lambda ks: sum(np.maximum(0, n - k + 1) for k in ks)
    total, at = (2 + many(sizes))[:, None], 0
    for k in sizes:
        np.divide(counts(k), total, out=x[:, at : at + 4**k])
        at += 4**k
    share = counts(1) / np.maximum(1, n)[:, None]
    x[:, at], x[:, at + 1] = np.minimum(1.0, n / 30), share[:, 2] + share[:, 1]
    at += 2
    if blocks in ("composition", "full"):
        x[:, at : at + 4], x[:, at + 4] = share, -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1) / 2
        at += 5
    if blocks in ("positional", "full"):
        tagged = [k for k in sizes if k <= 4]
        held = np.maximum(1, many(tagged))[:, None]
        for k in tagged:
            r, _, p = codes[k]
            middle = (p + k / 2) / np.maximum(1, n)[r]
            region = (middle >= 1 / 3).astype(np.int64) + (middle >= 2 / 3)
            np.divide(counts(k, 3, region), held, out=x[:, at : at + 3 * 4**k])
            at += 3 * 4**k
    if blocks in ("terminals", "full"):
        for k in (2, 3, 4):
            some = np.flatnonzero(n >= k)
            x[some, at + plain[k][first[some]]] = 0.25
            x[some, at + 4**k + plain[k][first[some] + n[some] - k]] = 0.25
            at += 2 * 4**k
    return (2 / total)[:, 0]


def family_weights(families: list[str], evidence: np.ndarray) -> np.ndarray:
    sizes = pd.Series(families).map(pd.Series(families).value_counts()).to_numpy(float)
    balanced = evidence / sizes
    return balanced * (evidence.sum() / max(1e-12, balanced.sum()))


def contrast_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, l2: float, l1: float, bias: float, rate: float = 0.8) -> tuple[np.ndarray, float]:
    """Weighted logistic descent with a decaying rate and a soft threshold after each step."""
    w, total = np.zeros(x.shape[1]), max(1.0, weight.sum())
    for epoch in range(epochs):
        step = rate / np.sqrt(1 + epoch / 80)
        e = weight * (sigmoid(x @ w + bias) - y)
        moved = w - step * (x.T @ e / total + l2 * w)
        w = np.sign(moved) * np.maximum(0.0, np.abs(moved) - step * l1)
        bias -= step * e.sum() / total
    return w, float(bias)


class Ensemble:
    """Bags of unlabelled entries contrasted with the positives."""

    def __init__(self, positives: pd.DataFrame, unlabelled: pd.DataFrame, config: tuple, bags: int, size: int, epochs: int, salt: str):
        _, self.sizes, self.blocks, l2, l1, ratio, least = config
        weights = family_weights(positives["family"].tolist(), positives["evidence"].to_numpy(float))
        columns = feature_columns(self.sizes, self.blocks)
        presence = np.zeros(len(columns))
        for part in range(0, len(positives), 64):
            x, _ = dense_features(positives["sequence"].tolist()[part : part + 64], self.sizes, self.blocks)
            presence += weights[part : part + 64] @ (x > 0)
        self.vocabulary = sorted({f for f, p in zip(columns, presence, strict=True) if f.startswith("composition:") or p >= least} | {"seed:" + s[1:8] for s in positives["sequence"]})
        self.at = {f: i for i, f in enumerate(self.vocabulary)}
        names, texts = unlabelled["name"].tolist(), unlabelled["sequence"].tolist()
        self.weights, self.biases, self.members = [], [], []
        for bag in range(bags):
            order = range(len(names)) if len(names) <= size else sorted(range(len(names)), key=lambda i: (fnv1a_py(f"{salt}|{bag}|{names[i]}"), names[i]))[:size]
            chosen = list(order)
            x = self.matrix([*positives["sequence"], *(texts[i] for i in chosen)])
            y = np.r_[np.ones(len(positives)), np.zeros(len(chosen))]
            total = weights.sum()
            row_weight = np.r_[weights, np.full(len(chosen), total * ratio / max(1, len(chosen)))]
            w, b = contrast_fit(x, y, row_weight, epochs, l2, l1, float(np.log((total + 1) / (total * ratio + 1))))
            self.weights.append(w)
            self.biases.append(b)
            self.members.append({names[i] for i in chosen})

    def matrix(self, sequences: pd.Series | list[str]) -> np.ndarray:
        columns = feature_columns(self.sizes, self.blocks)
        kept = [f for f in self.vocabulary if f in columns]
        to, source = [self.at[f] for f in kept], [columns[f] for f in kept]
        x, texts = np.zeros((len(sequences), len(self.vocabulary))), list(sequences)
        for part in range(0, len(texts), 64):
            some = texts[part : part + 64]
            dense, mass = dense_features(some, self.sizes, self.blocks)
            x[part : part + 64, to] = dense[:, source]
            for i, s in enumerate(some):
                if (j := self.at.get("seed:" + s[1:8])) is not None:
                    x[part + i, j] = mass[i]
        return x

    def consensus(self, sequences: pd.Series) -> np.ndarray:
        return self.matrix(sequences) @ np.mean(self.weights, axis=0) + float(np.mean(self.biases))


def inner_folds(families: DataFrame, outer: int, inner: int) -> DataFrame:
    """(family, outer, inner): the outer fold of each family, and its inner folds by outer fold, null in its own."""
    def dealt(df: DataFrame, salt: Column, by: str, k: int, name: str) -> DataFrame:
        hashed = materialize(df.withColumn("_h", fnv1a(F.concat(salt, F.lit("|"), F.col("family")))))
        ranked = materialize(global_rank(hashed, [F.col(by), F.col("_h"), F.col("family")], "_r"))
        sizes = ranked.groupBy(by).agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
        return ranked.join(F.broadcast(sizes), by).withColumn(name, ((F.col("_r") - F.col("_first")) % F.least(F.lit(k), F.col("_n"))).cast("int")).drop("_h", "_r", "_first", "_n")

    placed = dealt(families.select("family").distinct().withColumn("_all", F.lit(0)), F.lit("outer"), "_all", outer, "outer").drop("_all")
    pairs = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).where("fold <> outer")
    inside = dealt(pairs, F.concat(F.lit("inner-"), (F.col("fold") + 1).cast("string")), "fold", inner, "inner")
    lists = inside.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("fold", "inner"))).alias("_m"))
    return placed.join(lists, "family", "left").select("family", "outer", F.transform(F.sequence(F.lit(0), F.lit(outer - 1)), lambda f: F.coalesce(F.try_element_at("_m", f), F.lit(-1))).alias("inner"))


def _drawn(base: DataFrame, draws: dict[tuple, int]) -> DataFrame:
    """(draw, name): for each draw (salt, size, positive or not, outer and inner fold it leaves out) the names with the smallest hashes of all."""

    def smallest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, pd.DataFrame] = {}
        for pdf in parts:
            positive, fold, inside = pdf["positive"].to_numpy(), pdf["outer"].to_numpy(), np.array(pdf["inner"].tolist())
            for (salt, size, side, place), draw in draws.items():
                here = positive == side
                if place:
                    here &= (fold != place[0]) & ((inside[:, place[0]] != place[1]) if place[1] is not None else True)
                names = pdf["name"].to_numpy()[here]
                got = pd.DataFrame({"hash": fnv1a_np(f"{salt}|", names.tolist()), "name": names})
                best[draw] = pd.concat([best[draw], got] if draw in best else [got]).sort_values(["hash", "name"]).head(size)
        for draw, rows in best.items():
            yield rows.assign(draw=draw)[["draw", "hash", "name"]]

    sizes = base.sparkSession.createDataFrame([(i, key[1]) for key, i in draws.items()], "draw int, size int")
    found = base.select("name", "positive", "outer", "inner").mapInPandas(smallest, "draw int, hash long, name string").join(F.broadcast(sizes), "draw")
    w = Window.partitionBy("draw").orderBy("hash", "name")
    return found.withColumn("_k", F.row_number().over(w)).where("_k <= size").select("draw", "name")


def _trained(base: DataFrame, fits: list[dict], max_positives: int) -> list[dict]:
    """The fits that have positives, each with its ``weights`` by feature and ``bias``: means over its bags.

    A fit learns from ``max_positives`` of its positives and ``size`` unlabelled entries a bag, those with the smallest hashes of all.
    """
    draws: dict[tuple, int] = {}
    uses = []
    for fit in fits:
        place = (fit["fold"], fit["k"])
        uses.append((draws.setdefault((f"positives-{fit['fold']}-{fit['k']}", max_positives, 1, place), len(draws)), fit["fit"], -1))
        uses += [(draws.setdefault((f"{fit['salt']}|{bag}", fit["size"], 0, None), len(draws)), fit["fit"], bag) for bag in range(fit["bags"])]
    used = base.sparkSession.createDataFrame(uses, "draw int, fit int, bag int")
    rows = materialize(_drawn(base, draws).join(base.select("name", "sequence", "family", "evidence"), "name"))
    spec = {f["fit"]: f for f in fits}

    def fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
        f = spec[int(pdf["fit"].iloc[0])]
        pdf = pdf.sort_values("name")
        positives = pdf[pdf["bag"] == -1].reset_index(drop=True)
        if positives.empty:
            return pd.DataFrame([], columns=["fit", "features", "weights", "bias"])
        models = []
        for bag in range(f["bags"]):
            rest = pdf[pdf["bag"] == bag].reset_index(drop=True)
            models.append(Ensemble(positives, rest, f["config"], 1, len(rest), f["epochs"], f["salt"]))
        weights = np.mean([m.weights[0] for m in models], axis=0)
        return pd.DataFrame({"fit": [f["fit"]], "features": [models[0].vocabulary], "weights": [weights.tolist()], "bias": [float(np.mean([m.biases[0] for m in models]))]})

    dealt = rows.join(F.broadcast(used), "draw").repartition(len(fits), "fit")
    models = dealt.groupBy("fit").applyInPandas(fit_one, "fit int, features array<string>, weights array<double>, bias double").collect()
    return [{**spec[m["fit"]], "weights": dict(zip(m["features"], m["weights"], strict=True)), "bias": m["bias"]} for m in sorted(models, key=lambda m: m["fit"])]


def _linear_scorer(models: list[dict]):  # noqa: ANN202
    """A function of sequences: logits of all models, a column each; a text's features are made once for each set of sizes."""
    groups = []
    for sizes in sorted({m["config"][1] for m in models}):
        at = [i for i, m in enumerate(models) if m["config"][1] == sizes]
        columns = feature_columns(sizes, "full")
        w, seeds = np.zeros((len(columns), len(at))), {}
        for j, i in enumerate(at):
            for f, v in models[i]["weights"].items():
                if f in columns:
                    w[columns[f], j] = v
                else:
                    seeds.setdefault(f[5:], np.zeros(len(at)))[j] = v
        groups.append((sizes, at, w, seeds))
    bias = np.array([m["bias"] for m in models])

    def scores(sequences: list[str]) -> np.ndarray:
        out = np.zeros((len(sequences), len(bias)))
        for part in range(0, len(sequences), 64):
            some = sequences[part : part + 64]
            for sizes, at, w, seeds in groups:
                x, mass = dense_features(some, sizes, "full")
                got = x @ w
                for i, s in enumerate(some):
                    if s[1:8] in seeds:
                        got[i] += mass[i] * seeds[s[1:8]]
                out[part : part + len(some), at] = got
        return np.round(out + bias, 10)

    return scores


#: Background scores of one range of a fit's scores, about, and entries whose scores are packed together.
RANGE_SCORES, PACKED_ROWS = 1 << 20, 8192
PACKED = "fit int, part int, held boolean, scores binary, families binary, counts binary, names array<string>"


def _packed(scores: np.ndarray, family: np.ndarray, held: np.ndarray, positive: np.ndarray, names: np.ndarray, edges: np.ndarray) -> Iterator[dict]:
    """The scores of some entries by all fits as PACKED rows: background scores sorted and counted, held-out ones with their names, by range."""
    rest = ~positive
    for fit in range(scores.shape[1]):
        s, f = scores[rest, fit], family[rest]
        order = np.lexsort((f, s))
        s, f = s[order], f[order]
        new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (f[1:] != f[:-1])]) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.r_[new, len(s)]).astype(np.int32)
        s, f = s[new], f[new]
        cuts = np.r_[0, np.searchsorted(s, edges[fit], side="left"), len(s)]
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[part], cuts[part + 1])
            yield {"fit": fit, "part": part, "held": False, "scores": s[own].tobytes(), "families": f[own].tobytes(), "counts": count[own].tobytes() if (count[own] > 1).any() else b"", "names": []}
        mine = np.flatnonzero(held[:, fit])
        parts = np.searchsorted(edges[fit], scores[mine, fit], side="right")
        for part in np.unique(parts).tolist():
            at = mine[parts == part]
            yield {"fit": fit, "part": part, "held": True, "scores": scores[at, fit].tobytes(), "families": family[at].tobytes(), "counts": b"", "names": names[at].tolist()}


def _counted(s: np.ndarray, f: np.ndarray, count: np.ndarray, held: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(4, held): background weight above and at each held-out score, of all and of its own family."""
    order = np.argsort(s, kind="stable")
    s, f, count = s[order], f[order], count[order]
    levels = np.unique(s)
    total = np.r_[0, np.cumsum(count)]
    left, right = np.searchsorted(s, held, side="left"), np.searchsorted(s, held, side="right")
    width = 2 * len(levels) + 2
    keys = f.astype(np.int64) * width + 2 * np.searchsorted(levels, s) + 1
    order = np.argsort(keys, kind="stable")
    keys, within = keys[order], np.r_[0, np.cumsum(count[order])]
    at = np.searchsorted(levels, held)
    exact = np.isin(held, levels)
    key = own.astype(np.int64) * width + 2 * at
    first, last = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key + exact, side="right")
    end = np.searchsorted(keys, (own.astype(np.int64) + 1) * width, side="left")
    return np.array([total[-1] - total[right], total[right] - total[left], within[end] - within[last], within[last] - within[first]])


def _percentiles(base: DataFrame, scored: list[dict], scorer) -> DataFrame:  # noqa: ANN001
    """(fit, name, family, percentile) of the positives that a fit holds out, among all background entries of other families.

    Each task scores entries where they are and packs the scores of each fit, sorted and counted, into one row a range of scores; a range, about
    RANGE_SCORES of them, is where held-out scores are placed among the others by binary search. So no entry becomes a row for each fit, no
    window holds a fit, and neither side is broadcast. Ranges come from a sample of the background and only decide what meets where.
    """
    folds = np.array([m["fold"] for m in scored])
    inner = np.array([-1 if m["k"] is None else m["k"] for m in scored])
    columns = ["name", "sequence", "family_id", "positive", "outer", "inner"]
    background = base.where("positive = 0")
    pools = materialize(background.groupBy("family_id").agg(F.count("*").alias("mates")))
    n = pools.agg(F.sum("mates")).first()[0] or 0
    ranges = max(1, -(-n // RANGE_SCORES))
    edges = np.zeros((len(scored), 0))
    if ranges > 1:

        def sampled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield pd.DataFrame({"scores": list(scorer(pdf))})

        some = background.where(F.pmod(F.xxhash64("name"), F.lit(n)) < 64 * ranges).select(columns)  # about 64 entries a range
        seen = np.array([r[0] for r in some.mapInPandas(sampled, "scores array<double>").collect()]).reshape(-1, len(scored))
        edges = np.quantile(seen, np.arange(1, ranges) / ranges, axis=0).T if len(seen) else edges

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in parts:
            positive = pdf["positive"].to_numpy() == 1
            inside = np.array(pdf["inner"].tolist()).reshape(len(pdf), -1)
            out = np.where(inner < 0, folds == pdf["outer"].to_numpy()[:, None], inside[:, folds] == inner) & positive[:, None]
            held.append((scorer(pdf), pdf["family_id"].to_numpy(np.int32), out, positive, pdf["name"].to_numpy(object)))
            if sum(len(h[1]) for h in held) >= PACKED_ROWS:
                yield pd.DataFrame(_packed(*(np.concatenate(x) for x in zip(*held, strict=True)), edges))
                held = []
        if held and any(len(h[1]) for h in held):
            yield pd.DataFrame(_packed(*(np.concatenate(x) for x in zip(*held, strict=True)), edges))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        column = lambda rows, name, kind: np.frombuffer(b"".join(rows[name]), kind)
        rest, mine = pdf[~pdf["held"]], pdf[pdf["held"]]
        s, f = column(rest, "scores", np.float64), column(rest, "families", np.int32)
        count = np.concatenate([np.frombuffer(c, np.int32) if c else np.ones(len(x) // 8, np.int32) for c, x in zip(rest["counts"], rest["scores"], strict=True)] or [np.zeros(0, np.int32)]).astype(np.int64)
        held, own = column(mine, "scores", np.float64), column(mine, "families", np.int32)
        above, tied, mates, same = _counted(s, f, count, held, own)
        names = [x for row in mine["names"] for x in row]
        found = pd.DataFrame({"family_id": own, "name": np.array(names, object), "greater": above, "tied": tied, "own_greater": mates, "own_tied": same})
        if ranges > 1:  # what ranges below have to add; of all under -2
            kinds = np.unique(np.r_[f, own])
            sums = np.bincount(np.searchsorted(kinds, f), count, len(kinds)).astype(np.int64)
            total = pd.DataFrame({"family_id": np.r_[kinds, -2].astype(np.int32), "name": None, "greater": np.r_[sums, count.sum()], "tied": 0, "own_greater": 0, "own_tied": 0})
            found = pd.concat([found, total])
        return found.assign(fit=int(pdf["fit"].iloc[0]), part=int(pdf["part"].iloc[0]))[["fit", "part", "family_id", "name", "greater", "tied", "own_greater", "own_tied"]]

    found = base.select(columns).mapInPandas(pack, PACKED).groupBy("fit", "part").applyInPandas(
        place, "fit int, part int, family_id int, name string, greater long, tied long, own_greater long, own_tied long"
    )
    found = materialize(found)
    held = found.where("name is not null")
    if ranges > 1:
        higher = Window.partitionBy("fit", "family_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
        totals = found.where("name is null").select("fit", "part", "family_id", F.coalesce(F.sum("greater").over(higher), F.lit(0)).alias("above"))
        every = totals.where("family_id = -2").select("fit", "part", F.col("above").alias("above_all"))
        held = held.join(every, ["fit", "part"]).join(totals, ["fit", "part", "family_id"])
        held = held.withColumns({"greater": F.col("greater") + F.col("above_all"), "own_greater": F.col("own_greater") + F.col("above")})
    families = base.where("positive = 1").select("family_id", "family").distinct().join(pools, "family_id", "left")
    worse = F.col("greater") - F.col("own_greater") + (F.col("tied") - F.col("own_tied")) / 2
    pool = F.greatest(F.lit(1), F.lit(n) - F.coalesce("mates", F.lit(0)))
    return held.join(families, "family_id").select("fit", "name", "family", (1 - worse / pool).alias("percentile"))


def _in_folds(entries: DataFrame, outer: int, inner: int) -> tuple[DataFrame, int]:
    """The entries, written, with numbers of the positives' families, their outer and inner folds (-1: none), and how many outer folds there are."""
    base = entries.select("name", "sequence", "family", F.col("positive").cast("int").alias("positive"), F.col("evidence").cast("double").alias("evidence"))
    folds = materialize(inner_folds(base.where("positive = 1"), outer, inner).coalesce(1).withColumn("family_id", F.monotonically_increasing_id().cast("int")))
    none, mine = F.array_repeat(F.lit(-1), outer), F.col("positive") == 1
    base = base.join(F.broadcast(folds), "family", "left").withColumns({
        "outer": F.when(mine, F.col("outer")).otherwise(-1), "inner": F.when(mine, F.col("inner")).otherwise(none), "family_id": F.coalesce("family_id", F.lit(-1)),
    })
    base = materialize(base)
    return base, (base.where("positive = 1").agg(F.max("outer")).first()[0] or 0) + 1


VALIDATED = "fold long, config string, inner_score double, name string, family string, scorer string, percentile double"


def nested_validation(
    entries: DataFrame, configs: tuple = CONFIGS, outer: int = 5, inner: int = 3, bags: int = 3, inner_bags: int = 1, size: int = 650, epochs: int = 150,
    inner_size: int = 450, inner_epochs: int = 70, ablations: tuple = ABLATIONS, max_positives: int = MAX_POSITIVES,
) -> DataFrame:
    """(fold, config, inner_score, name, family, scorer, percentile) of nested family validation with the paired ablation; folds count from 1.

    ``entries`` is (name, sequence, family, positive, evidence). Inner selection is by (mean family percentile, recall at 10 %, id);
    then come the selected fit, the baseline scorers (k-mers of the selected sizes), and the ablation of all representations with one salt. A fit
    learns from at most ``max_positives`` positives, fits run in parallel; all positives are scored against all background where they lie.
    :func:`ablation_summary` compares.
    """
    spark = entries.sparkSession
    base, count = _in_folds(entries, outer, inner)
    if count < 2:
        return spark.createDataFrame([], VALIDATED)
    fits: list[dict] = []

    def add(scorer: str, fold: int, k: int | None, config: tuple, n: int, many: int, rounds: int, salt: str) -> None:
        fits.append({"fit": len(fits), "scorer": scorer, "fold": fold, "k": k, "config": config, "bags": n, "size": many, "epochs": rounds, "salt": salt})

    for fold in range(count):
        for config in configs:
            for k in range(inner):
                add("inner", fold, k, config, inner_bags, inner_size, inner_epochs, f"inner-{fold + 1}-{k}-{config[0]}")
        for config in ablations:
            add(f"ablation:{config[2]}", fold, None, config, bags, size, epochs, f"outer-feature-ablation-{fold + 1}")
    models = _trained(base, fits, max_positives)
    linear = _linear_scorer(models)

    def placed(scored: list[dict], scorer) -> DataFrame:  # noqa: ANN001
        names = [(i, m["scorer"], m["fold"], m["config"][0] if m["config"] else "") for i, m in enumerate(scored)]
        named = spark.createDataFrame(names, "fit int, scorer string, fold long, used string")
        return materialize(_percentiles(base, scored, scorer).join(F.broadcast(named), "fit").drop("fit"))

    def first(pdf: pd.DataFrame) -> np.ndarray:
        return linear(pdf["sequence"].tolist())

    got = placed(models, first)
    by = got.where("scorer = 'inner'").groupBy("fold", "used", "family").agg(F.avg("percentile").alias("p")).groupBy("fold", "used").agg(F.avg("p").alias("p"), F.avg((F.col("p") >= 0.9).cast("double")).alias("r"))
    compared = {(r["fold"], r["used"]): (r["p"], r["r"]) for r in by.collect()}
    best = [min((*(-v for v in compared.get((fold, c[0]), (0.0, 0.0))), c[0], c) for c in configs) for fold in range(count)]
    final = [{"fit": fold, "scorer": "ensemble", "fold": fold, "k": None, "config": b[3], "bags": bags, "size": size, "epochs": epochs, "salt": f"outer-{fold + 1}-{b[2]}"} for fold, b in enumerate(best)]
    final = _trained(base, final, max_positives)
    plain = [{"scorer": b, "fold": fold, "k": None, "config": None} for fold in range(count) for b in BASELINES]
    selected, simple = _linear_scorer(final), baseline_scorer(*baseline_profiles(base, [b[3][1] for b in best]))

    def second(pdf: pd.DataFrame) -> np.ndarray:
        return np.hstack([selected(pdf["sequence"].tolist()), simple(pdf)])

    chosen = spark.createDataFrame([(fold, b[2], float(-b[0])) for fold, b in enumerate(best)], "fold long, config string, inner_score double")
    out = got.where("scorer <> 'inner'").unionByName(placed([*final, *plain], second))
    used = F.when(F.col("scorer").startswith("ablation:"), F.col("used")).otherwise(F.col("config")).alias("config")
    return out.join(F.broadcast(chosen), "fold").select((F.col("fold") + 1).alias("fold"), used, "inner_score", "name", "family", "scorer", "percentile")


# --- fits over all positives ----------------------------------------------------------------------


#: Rows whose features are looked at together in a fit over all positives, and bytes of a fold's features and sequences up to which one task holds them.
FIT_ROWS, FOLD_BYTES = 256, 320 << 20


class ContrastRows:
    """Some training rows: full features, seeds, and a weight in each place (a fold and bag); adds up what they give to a step of all models there."""

    def __init__(self, x: np.ndarray, mass: np.ndarray, seed: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.x, self.y, self.weight = x, y, weight
        order = np.argsort(seed, kind="stable")
        self.seeded = order[seed[order] >= 0]  # rows whose seed some fold knows, in its order
        own = seed[self.seeded]
        self.mass, self.first = mass[self.seeded][:, None], np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
        self.seed, self.kinds = own, own[self.first]

    def presence(self, first: np.ndarray) -> np.ndarray:
        """(places, features): the weight of the positives that have a feature, of the places named."""
        return (self.weight[:, first] * self.y[:, None]).T @ (self.x > 0)

    def add_gradient(self, fits: ContrastFits, out: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        n = len(fits.configs)
        here = np.repeat(self.weight.any(axis=0), n)
        use = np.flatnonzero(here)
        z = np.tile(fits.bias[use], (len(self.x), 1))
        parts = [(p, np.flatnonzero(m[use]), np.flatnonzero(m & here)) for p, m in fits.parts]
        for p, at, models in parts:
            z[:, at] += self.x[:, p] @ fits.w[p, models]
        if len(self.seeded):
            z[self.seeded] += self.mass * fits.s[self.seed][:, use]
        e = np.repeat(self.weight, n, axis=1)[:, use] * (sigmoid(z) - self.y[:, None])
        for p, at, models in parts:
            out[0][p, models] += self.x[:, p].T @ e[:, at]
        if len(self.seeded):
            out[1][np.ix_(self.kinds, use)] += np.add.reduceat(self.mass * e[self.seeded], self.first, axis=0)
        out[2][use] += e.sum(axis=0)


class ContrastFits:
    """Models of some places and configurations, a column each (by place, then configuration), as :func:`contrast_fit` takes them from step to step.

    ``known`` says which seeds the positives of a place have, ``total`` is their evidence, ``drawn`` how many unlabelled entries its bag has.
    """

    def __init__(self, configs: tuple, known: np.ndarray, total: np.ndarray, drawn: np.ndarray, presence: np.ndarray):
        self.configs, columns = configs, feature_columns(configs[0][1], "full")
        names, n = list(columns), len(total)
        own = [set(feature_columns(c[1], c[2])) for c in configs]
        cuts = [0, *(i for i in range(1, len(names)) if [names[i] in o for o in own] != [names[i - 1] in o for o in own]), len(names)]
        self.parts = [(slice(a, b), np.tile([names[a] in o for o in own], n)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        plain = np.array([f.startswith("composition:") for f in names])
        # sums of the same weights in another order differ by less than 1e-9
        wide = np.column_stack([(plain | (presence[place] >= c[6] - 1e-9)) & [f in o for f in names] for place in range(n) for c, o in zip(configs, own, strict=True)])
        self.open, self.known = wide, np.repeat(known, len(configs), axis=1)
        of = lambda i: np.tile([c[i] for c in configs], n)
        self.l2, self.l1, ratio, whole = of(3), of(4), of(5), np.repeat(total, len(configs))
        self.total = np.maximum(1.0, whole + whole * ratio * np.repeat(drawn > 0, len(configs)))
        self.w, self.s, self.bias = np.zeros(wide.shape), np.zeros(self.known.shape), np.log((whole + 1) / (whole * ratio + 1))

    def zeros(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(self.w.shape), np.zeros(self.s.shape), np.zeros(self.bias.shape)

    def step(self, gradient: tuple[np.ndarray, np.ndarray, np.ndarray], epoch: int, rate: float = 0.8) -> None:
        step = rate / np.sqrt(1 + epoch / 80)

        def moved(w: np.ndarray, g: np.ndarray, kept: np.ndarray) -> np.ndarray:
            w = w - step * (g / self.total + self.l2 * w)
            return np.where(kept, np.sign(w) * np.maximum(0.0, np.abs(w) - step * self.l1), 0.0)

        self.w, self.s = moved(self.w, gradient[0], self.open), moved(self.s, gradient[1], self.known)
        self.bias = self.bias - step * gradient[2] / self.total


def _packed_counts(x: np.ndarray, mass: np.ndarray, sizes: tuple[int, ...]) -> dict:
    """Rows of full features as counts of few bytes: they are k-mer counts over a row's total, and quarters; composition is kept as it is."""
    n = sum(4**k for k in sizes)
    total = np.rint(2 / mass)
    held = np.maximum(1, np.rint(x[:, :n] * total[:, None])[:, : sum(4**k for k in sizes if k <= 4)].sum(axis=1))
    counts = np.column_stack([x[:, :n] * total[:, None], x[:, n + 7 : -672] * held[:, None], x[:, -672:] * 4])
    kind = next(k for k in ("uint8", "uint16", "uint32") if counts.max(initial=0) <= np.iinfo(k).max)
    return {"kind": kind, "counts": np.rint(counts).astype(kind).tobytes(), "plain": x[:, n : n + 7].tobytes(), "total": np.column_stack([total, held]).tobytes()}


def _unpacked_counts(row: dict, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The same features and the values of the seeds."""
    n = sum(4**k for k in sizes)
    plain, total = np.frombuffer(row["plain"]).reshape(-1, 7), np.frombuffer(row["total"]).reshape(-1, 2)
    counts = np.frombuffer(row["counts"], row["kind"]).reshape(len(plain), -1)
    x = np.empty((len(plain), counts.shape[1] + 7))
    np.divide(counts[:, :n], total[:, :1], out=x[:, :n])
    x[:, n : n + 7] = plain
    np.divide(counts[:, n:-672], total[:, 1:], out=x[:, n + 7 : -672])
    np.divide(counts[:, -672:], 4.0, out=x[:, -672:])
    return x, 2 / total[:, 0]


def _whole_fits(base: DataFrame, count: int, configs: tuple, bags: int, size: int, epochs: int, salt: str, held_bytes: int = FOLD_BYTES) -> list[dict]:
    """The models of every outer fold and configuration, each from all positives of the other folds and its bags: no fit leaves a positive out.

    ``salt`` names a fold's bags by {fold}, from 1. Configurations share their k-mer sizes. Rows of a fold that take no more than ``held_bytes`` are held by one task for all epochs;
    more are dealt over the cluster as packed counts, and an epoch of all models is one job, a row a task, whose step the driver takes. Both give the same models.
    """
    spark, sizes = base.sparkSession, configs[0][1]
    if {c[1] for c in configs} != {sizes} or 4 < max(sizes):
        raise ValueError("configurations must share k-mer sizes of up to 4")
    places = [(fold, bag) for fold in range(count) for bag in range(bags)]
    positives = base.where("positive = 1")
    mates = positives.groupBy("family").agg(F.count("*").alias("mates"))
    mine = positives.join(mates, "family").select("name", "sequence", "outer", F.lit(-1).alias("draw"), F.col("evidence"), (F.col("evidence") / F.col("mates")).alias("balanced"))
    draws = {(f"{salt.format(fold=fold + 1)}|{bag}", size, 0, None): i for i, (fold, bag) in enumerate(places)}
    rest = _drawn(base, draws).join(base.select("name", "sequence"), "name").select("name", "sequence", F.lit(-1).alias("outer"), "draw", F.lit(0.0).alias("evidence"), F.lit(0.0).alias("balanced"))
    seed = F.substring("sequence", 2, 7).alias("seed")
    rows = materialize(mine.unionByName(rest).select("*", seed))
    facts = {(r["outer"], r["draw"]): r for r in rows.groupBy("outer", "draw").agg(F.count("*").alias("n"), F.sum("evidence").alias("evidence"), F.sum("balanced").alias("balanced"), F.sum(F.length("sequence")).alias("letters")).collect()}
    over = lambda name, fold: sum(r[name] for (outer, draw), r in sorted(facts.items()) if draw < 0 and outer != fold)
    total = np.array([over("evidence", fold) for fold, _ in places])
    scale = total / np.array([max(1e-12, over("balanced", fold)) for fold, _ in places])
    drawn = np.array([facts[-1, i]["n"] if (-1, i) in facts else 0 for i in range(len(places))])
    ratio = {c[5] for c in configs}
    if len(ratio) != 1:
        raise ValueError("configurations must share the weight of unlabelled entries")
    light = total * ratio.pop() / np.maximum(1, drawn)
    seeds = rows.where("draw < 0").select("seed", "outer").distinct().collect()  # seeds have up to seven letters
    names = {s: i for i, s in enumerate(sorted({r["seed"] for r in seeds}))}
    known = np.zeros((len(names), len(places)), bool)
    for r in seeds:
        known[names[r["seed"]]] |= [fold != r["outer"] for fold, _ in places]

    def chunks(pdf: pd.DataFrame) -> Iterator[tuple]:
        """(features, seed values, seeds, labels, weights by place) of the rows, some at a time."""
        for begin in range(0, len(pdf), FIT_ROWS):
            some = pdf.iloc[begin : begin + FIT_ROWS]
            outer, draw = some["outer"].to_numpy()[:, None], some["draw"].to_numpy()[:, None]
            x, mass = dense_features(some["sequence"].tolist(), sizes, "full")
            weight = np.where(draw < 0, some["balanced"].to_numpy()[:, None] * scale * (outer != [fold for fold, _ in places]), light * (draw == np.arange(len(places))))
            yield x, mass, np.array([names.get(s, -1) for s in some["seed"]], np.int64), (draw[:, 0] < 0).astype(float), weight

    def described(fits: ContrastFits, some: list[int]) -> list[tuple]:
        """(fold, configuration, means over the bags) of the places."""
        out, n = [], len(fits.configs)
        for fold in sorted({places[i][0] for i in some}):
            for c in range(n):
                at = [j * n + c for j, i in enumerate(some) if places[i][0] == fold]
                out.append((fold, c, fits.w[:, at].mean(axis=1).tobytes(), fits.s[:, at].mean(axis=1).tobytes(), float(fits.bias[at].mean()), fits.open[:, at[0]].tobytes(), fits.known[:, at[0]].tobytes()))
        return out

    kind = "fold int, config int, w binary, s binary, bias double, open binary, known binary"
    row_bytes = 8 * len(feature_columns(sizes, "full"))
    largest = max(sum(row_bytes * r["n"] + 2 * r["letters"] for (outer, draw), r in facts.items() if (draw < 0 and outer != fold) or (draw >= 0 and places[draw][0] == fold)) for fold in range(count))
    if largest <= held_bytes:

        def fit_fold(pdf: pd.DataFrame) -> pd.DataFrame:
            some = [i for i, (fold, _) in enumerate(places) if fold == pdf["fold"].iloc[0]]
            held = [ContrastRows(*c[:4], c[4][:, some]) for c in chunks(pdf.sort_values(["draw", "name"]))]
            presence = np.repeat(sum(c.presence(np.array([0])) for c in held), len(some), axis=0)
            fits = ContrastFits(configs, known[:, some], total[some], drawn[some], presence)
            for epoch in range(epochs):
                gradient = fits.zeros()
                for c in held:
                    c.add_gradient(fits, gradient)
                fits.step(gradient, epoch)
            return pd.DataFrame(described(fits, some), columns=[c.split()[0] for c in kind.split(", ")])

        fold_of = F.array(*(F.lit(fold) for fold, _ in places))
        dealt = rows.withColumn("fold", F.explode(F.when(F.col("draw") < 0, F.array_except(F.sequence(F.lit(0), F.lit(count - 1)), F.array("outer"))).otherwise(F.array(F.element_at(fold_of, F.greatest("draw", F.lit(0)) + 1)))))
        found = dealt.repartition(count, "fold").groupBy("fold").applyInPandas(fit_fold, kind).collect()
    else:

        def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for x, mass, seed, y, weight in chunks(pdf):
                    yield pd.DataFrame([{**_packed_counts(x, mass, sizes), "seed": seed.tobytes(), "y": y.tobytes(), "weight": weight.tobytes()}])

        with large_rows(spark):
            stored = rows.repartitionByRange("draw", "outer", "seed", "name").sortWithinPartitions("draw", "outer", "seed", "name")
            stored = materialize(stored.mapInPandas(pack, "kind string, counts binary, plain binary, total binary, seed binary, y binary, weight binary"))
            stored = stored.coalesce(spark.sparkContext.defaultParallelism)
            read = lambda batch: (ContrastRows(*_unpacked_counts(r, sizes), np.frombuffer(r["seed"], np.int64), np.frombuffer(r["y"]), np.frombuffer(r["weight"]).reshape(-1, len(places))) for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
            first = np.arange(0, len(places), bags)

            def count_presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros((count, len(feature_columns(sizes, "full"))))
                for batch in batches:
                    for c in read(batch):
                        out += c.presence(first)
                yield pa.RecordBatch.from_pydict({"p": [out.tobytes()]})

            presence = sum(np.frombuffer(r["p"]) for r in stored.mapInArrow(count_presence, "p binary").collect()).reshape(count, -1)
            fits = ContrastFits(configs, known, total, drawn, np.repeat(presence, bags, axis=0))
            for epoch in range(epochs):
                sent = spark.sparkContext.broadcast(fits)

                def add(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                    out = sent.value.zeros()
                    for batch in batches:
                        for c in read(batch):
                            c.add_gradient(sent.value, out)
                    yield pa.RecordBatch.from_pydict({n: [g.tobytes()] for n, g in zip(("w", "s", "b"), out, strict=True)})

                got = stored.mapInArrow(add, "w binary, s binary, b binary").collect()  # a row a task
                fits.step(tuple(sum(np.frombuffer(r[n]) for r in got).reshape(z.shape) for n, z in zip(("w", "s", "b"), fits.zeros(), strict=True)), epoch)
                sent.destroy()
        found = spark.createDataFrame(described(fits, list(range(len(places)))), kind).collect()
    models, columns, texts = [], list(feature_columns(sizes, "full")), list(names)
    for r in sorted(found, key=lambda r: (r["fold"], r["config"])):
        weights = {f: v for f, v, o in zip(columns, np.frombuffer(r["w"]).tolist(), np.frombuffer(r["open"], bool).tolist(), strict=True) if o}
        weights |= {f"seed:{s}": v for s, v, o in zip(texts, np.frombuffer(r["s"]).tolist(), np.frombuffer(r["known"], bool).tolist(), strict=True) if o}
        models.append({"fit": len(models), "fold": r["fold"], "k": None, "config": configs[r["config"]], "weights": weights, "bias": r["bias"]})
    return models


def ablation_validation(entries: DataFrame, outer: int = 5, bags: int = 3, size: int = 650, epochs: int = 150, ablations: tuple = ABLATIONS, held_bytes: int = FOLD_BYTES) -> DataFrame:
    """(fold, config, name, family, scorer, percentile) of the paired ablation alone: the same folds, bags and salts as in :func:`nested_validation`, but all positives of the other folds are learnt from.

    The ablation takes nothing from the selection, so no inner fits are made. Every positive is scored against all background. :func:`ablation_summary` compares.
    """
    spark = entries.sparkSession
    for name, value in WORKER_ENVIRONMENT.items():
        spark.sparkContext.environment.setdefault(name, value)
    base, count = _in_folds(entries, outer, 1)
    if count < 2:
        return spark.createDataFrame([], VALIDATED).drop("inner_score")
    models = _whole_fits(base, count, ablations, bags, size, epochs, "outer-feature-ablation-{fold}", held_bytes)
    linear = _linear_scorer(models)
    named = spark.createDataFrame([(m["fit"], m["fold"] + 1, m["config"][0], f"ablation:{m['config'][2]}") for m in models], "fit int, fold long, config string, scorer string")
    found = _percentiles(base, models, lambda pdf: linear(pdf["sequence"].tolist()))
    return materialize(found.join(F.broadcast(named), "fit").select("fold", "config", "name", "family", "scorer", "percentile"))


def ablation_summary(validated: DataFrame, bootstraps: int = 4000, flips: int = 10_000) -> DataFrame:
    """One row a representation of the ablation: family mean with its bootstrap intervals, and its paired comparison with core, BH over those."""
    families = materialize(validated.where(F.col("scorer").startswith("ablation:")).groupBy(F.substring_index("scorer", ":", -1).alias("blocks"), "family").agg(F.avg("percentile").alias("p")))
    core = families.where("blocks = 'core'").select("family", F.col("p").alias("q"))
    rows, tests = [], []
    for blocks in sorted(r[0] for r in families.select("blocks").distinct().collect()):
        own = families.where(F.col("blocks") == blocks)
        row = own.agg(F.count("*").alias("families"), F.avg("p").alias("mean_percentile")).join(bootstrap_interval(own, "family", "p", iterations=bootstraps))
        rows.append(row.withColumn("blocks", F.lit(blocks)))
        if blocks != "core":
            pairs = own.join(core, "family").select("family", (F.col("p") - F.col("q")).alias("d"))
            test = paired_comparison(pairs, "family", "d", fnv1a_py(f"feature-bootstrap|{blocks}"), fnv1a_py(f"feature-sign-flip|{blocks}"), bootstraps, flips)
            tests.append(test.withColumn("blocks", F.lit(blocks)))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(rows).join(benjamini_hochberg(union(tests)), "blocks", "left") if tests else union(rows)


#: Scorers to compare with: seed matches, k-mer centroid, composition, and a hash.
BASELINES = ("seed", "centroid", "composition", "hash")


def baseline_profiles(base: DataFrame, sizes: list[tuple[int, ...]]) -> tuple[list[tuple[tuple[int, ...], np.ndarray, float, float]], list[dict[str, float]]]:
    """By fold: (k-mer sizes, k-mer centroid, mean length, mean GC share) of the other folds' positives, and the best share of equal letters with their seeds, by seed.

    ``sizes`` are the k-mer sizes of each fold. Seeds have at most seven letters, so there are at most 21,845 of them.
    """
    folds, kinds = len(sizes), sorted(set(sizes))
    widths = [len(feature_columns(k, "core")) + 1 for k in kinds]

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros((folds, w)) for w in widths]
        for pdf in parts:
            texts, fold = pdf["sequence"].tolist(), pdf["outer"].to_numpy()
            for begin in range(0, len(texts), 64):
                some = texts[begin : begin + 64]
                for kind, out in zip(kinds, total, strict=True):
                    x, _ = dense_features(some, kind, "core")
                    kmers = x[:, :-2] / np.maximum(1e-300, x[:, :-2].sum(axis=1, keepdims=True))
                    v = np.column_stack([kmers, [len(s) for s in some], x[:, -1], np.ones(len(x))])
                    np.add.at(out, fold[begin : begin + 64], v)
        for i, out in enumerate(total):
            yield pd.DataFrame({"kind": i, "outer": range(folds), "v": [row.tobytes() for row in out]})

    totals = [np.zeros((folds, w)) for w in widths]
    positives = base.where("positive = 1")

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(v=[np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()])

    parts = positives.select("sequence", "outer").mapInPandas(sums, "kind int, outer int, v binary")
    for r in parts.groupBy("kind", "outer").applyInPandas(added, "kind int, outer int, v binary").collect():  # a row a fold and kind
        totals[r["kind"]][r["outer"]] = np.frombuffer(r["v"])
    profiles = []
    for fold in range(folds):
        own = totals[kinds.index(sizes[fold])]
        mean = (own.sum(axis=0) - own[fold]) / max(1.0, own[:, -1].sum() - own[fold, -1])
        profiles.append((sizes[fold], mean[:-3], float(mean[-3]), float(mean[-2])))
    seed = F.substring("sequence", 2, 7).alias("seed")
    every = [r["seed"] for r in base.select(seed).distinct().orderBy("seed").collect()]
    train = [(r["outer"], r["seed"]) for r in positives.select("outer", seed).distinct().collect()]

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        fold = int(pdf["fold"].iloc[0])
        known = sorted({s for f, s in train if f != fold})
        letters = lambda texts, pad: np.array([list(s.ljust(7, pad).encode()) for s in texts], np.uint8).reshape(len(texts), 7)
        k, size = letters(known, "#"), np.array([len(s) for s in known])
        out = []
        for s, row in zip(every, letters(every, "-"), strict=True):
            out.append(float(((k == row).sum(axis=1) / np.maximum(1, np.maximum(size, len(s)))).max(initial=0.0)))
        return pd.DataFrame({"fold": fold, "best": [out]})

    spark = base.sparkSession
    near = spark.range(folds).withColumnRenamed("id", "fold").groupBy("fold").applyInPandas(nearest, "fold int, best array<double>").collect()
    return profiles, [dict(zip(every, r["best"], strict=True)) for r in sorted(near, key=lambda r: r["fold"])]


def baseline_scorer(profiles: list[tuple[tuple[int, ...], np.ndarray, float, float]], seeds: list[dict[str, float]]):  # noqa: ANN201
    """A function of (name, sequence): the scores of the baselines, by fold, then by scorer."""

    def scores(pdf: pd.DataFrame) -> np.ndarray:
        texts, names = pdf["sequence"].tolist(), pdf["name"].tolist()
        near = {kind: np.zeros((len(texts), len(profiles))) for kind in {p[0] for p in profiles}}
        gc, size = np.zeros(len(texts)), np.array([len(s) for s in texts], float)
        for begin in range(0, len(texts), 64):
            some = slice(begin, begin + 64)
            for kind, out in near.items():
                x, _ = dense_features(texts[some], kind, "core")
                kmers, gc[some] = x[:, :-2], x[:, -1]
                norm = np.sqrt((kmers * kmers).sum(axis=1))
                for fold, (own, center, _, _) in enumerate(profiles):
                    if own == kind:
                        both = norm * np.sqrt(center @ center)
                        out[some, fold] = np.where(both > 0, kmers @ center / np.where(both > 0, both, 1), 0.0)
        out = []
        for fold, (kind, _, length, share) in enumerate(profiles):
            far = (np.abs(size - length) / max(1.0, length) + np.abs(gc - share)) / 2
            out += [[seeds[fold][s[1:8]] for s in texts], near[kind][:, fold], 1 - np.minimum(1, far), fnv1a_np(f"random-baseline|{fold + 1}|", names) / 0xFFFFFFFF]
        return np.round(np.column_stack(out), 10)

    return scores


def sequence_kmers(s: str, sizes: tuple[int, ...] = (2, 3, 4)) -> dict[str, float]:
    out: dict[str, float] = {}
    for k in sizes:
        for i in range(len(s) - k + 1):
            out[s[i : i + k]] = out.get(s[i : i + k], 0.0) + 1
    total = sum(out.values()) or 1.0
    return {f: v / total for f, v in out.items()}


def rank_candidates(entries: DataFrame, config: tuple = CONFIGS[0], bags: int = 20, size: int = 800, epochs: int = 420, salt: str = "final", max_positives: int = MAX_POSITIVES) -> DataFrame:
    """(name, score, oob_models, fallback, median, q25, q75, top_1, top_5, top_10, top_20, features): out-of-bag scores of all unlabelled entries.

    Fitted on at most ``max_positives`` positives, those with the smallest hashes, and bags of ``size`` unlabelled entries drawn
    from all of them; bags are fitted in parallel. The models, a bounded number of weights, then score every entry
    where it is; stability is the spread of an entry's percentile over the bags it was not in.
    """
    base = entries.select("name", "sequence", "family", F.col("positive").cast("int").alias("positive"), F.col("evidence").cast("double").alias("evidence"))
    positives = base.where("positive = 1").orderBy(fnv1a(F.concat(F.lit(f"{salt}|"), F.col("name"))), "name").limit(max_positives).toPandas().sort_values("name")
    rest = base.where("positive = 0")
    schema = "name string, score double, oob_models int, fallback boolean, features array<string>, logits array<double>"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        e = Ensemble(positives, pdf.sort_values("name").reset_index(drop=True), config, 1, len(pdf), epochs, salt)
        return pd.DataFrame({"bag": [int(pdf["bag"].iloc[0])], "weights": [e.weights[0].tolist()], "bias": [e.biases[0]], "names": [pdf["name"].tolist()]})

    models = []
    if len(positives):
        drawn = hash_bags(rest.select("name", "sequence"), "name", bags, size, salt)
        models = sorted(drawn.groupBy("bag").applyInPandas(fit, "bag int, weights array<double>, bias double, names array<string>").collect(), key=lambda r: r["bag"])
    if not models:
        return entries.sparkSession.createDataFrame([], RANKED)
    ensemble = Ensemble(positives, positives.iloc[:0], config, 0, 0, 0, salt)
    weights, biases = np.array([m["weights"] for m in models]), np.array([m["bias"] for m in models])
    members = [frozenset(m["names"]) for m in models]

    def score_part(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = ensemble.matrix(pdf["sequence"])
            logits = x @ weights.T + biases
            outside = np.array([[n not in m for m in members] for n in pdf["name"]]).reshape(len(pdf), len(members))
            count = outside.sum(axis=1)
            use = np.where(count[:, None] > 0, outside, True)
            best = []
            for row in x * (use @ weights / use.sum(axis=1, keepdims=True)):  # by the models that score the entry
                top = np.argsort(-row, kind="stable")[:10]
                best.append([ensemble.vocabulary[j] for j in top if row[j] > 0])
            held = [[float(z) if o else None for z, o in zip(a, b, strict=True)] for a, b in zip(logits, outside, strict=True)]
            yield pd.DataFrame({"name": pdf["name"], "score": (logits * use).sum(axis=1) / use.sum(axis=1), "oob_models": count, "fallback": count == 0, "features": best, "logits": held})

    scored = rest.select("name", "sequence").mapInPandas(score_part, schema)
    each = scored.select("name", F.posexplode("logits").alias("bag", "logit")).where("logit is not null")
    ranked = materialize(global_rank(each, ["bag", "logit", "name"]))  # by ranges over all bags: no bag is one task's window
    sizes = ranked.groupBy("bag").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    at = (F.col("rank") - F.col("first")) / F.greatest(F.lit(1), F.col("n") - 1)
    p = ranked.join(F.broadcast(sizes), "bag").select("name", F.when(F.col("n") == 1, 1.0).otherwise(at).alias("percentile"))
    q = lambda x: F.percentile("percentile", x)
    share = lambda c: F.avg((F.col("percentile") >= c).cast("double"))
    spread = p.groupBy("name").agg(q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), share(0.99).alias("top_1"), share(0.95).alias("top_5"), share(0.9).alias("top_10"), share(0.8).alias("top_20"))
    return scored.drop("logits").join(spread, "name", "left").select("name", "score", "oob_models", "fallback", "median", "q25", "q75", "top_1", "top_5", "top_10", "top_20", "features")


def choose_configuration(validated: DataFrame) -> DataFrame:
    """One row: the configuration selected most often over the outer folds, then by mean inner score, then by id."""
    per = validated.where("scorer = 'ensemble'").select("fold", "config", "inner_score").distinct()
    return per.groupBy("config").agg(F.count("*").alias("selected"), F.avg("inner_score").alias("inner_score")).orderBy(F.desc("selected"), F.desc("inner_score"), F.collate("config", "UNICODE")).limit(1)
