"""Linear text classifiers on character n-grams scaled by naive Bayes log-count ratios.

A feature is whether an n-gram (hashed) occurs in the text. For each class the log ratio of the
smoothed feature counts inside and outside the class scales the feature; a ridge-penalised logistic
regression is fitted on the scaled features, one class against the rest. N-grams that few rows of the smaller side
have, or whose ratio is near 0, get no weight: :class:`Choice` says how few and how near.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_by, materialize, only, release, slices, utf8, written
from .ngrams import characters, distinct, hashed, letter_table, lower_table

#: Rows, and bytes of text, that a model is fitted on, about: the labelled rows with the smallest hashes.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 8000, 64 << 20


@dataclass(frozen=True)
class Choice:
    """Which n-grams get a weight: those in at least ``rows`` training rows and in as many as ``share`` of the smaller
    side's rows, whose log-count ratio is at least ``ratio`` from 0."""

    rows: int = 4
    share: float = 0.02
    ratio: float = 1.5

    def ratios(self, inside: np.ndarray, total: np.ndarray, positive: int, n: int) -> np.ndarray:
        """The log-count ratio of each n-gram, 0 where it gets no weight."""
        out = np.log((1 + inside) / (1 + positive)) - np.log((1 + total - inside) / (1 + n - positive))
        least = max(self.rows, self.share * min(positive, n - positive))
        out[(total < least) | (np.abs(out) < self.ratio)] = 0
        return out


@dataclass(frozen=True)
class LinearText:
    """Weights by class (one row against the rest; two classes need one row)."""

    labels: tuple[int, ...]
    sizes: tuple[int, ...]
    bits: int
    fold: bool
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, batch: pa.RecordBatch, column: str) -> np.ndarray:
        """(rows, weight rows): the bias plus the weights of the row's distinct n-grams."""
        out = np.tile(self.bias, (batch.num_rows, 1))
        used = (self.weights != 0).any(axis=0)
        rows, buckets = features(batch, column, self.sizes, self.bits, self.fold, used)
        for k in range(len(self.weights) if len(rows) else 0):
            out[:, k] += np.bincount(rows, weights=self.weights[k][buckets], minlength=batch.num_rows)
        return out

    def posteriors(self, batch: pa.RecordBatch, column: str) -> np.ndarray:
        """(rows, labels), each row of sum one."""
        p = 1 / (1 + np.exp(-np.clip(self.margins(batch, column), -35, 35)))
        if len(self.labels) == 1:
            return np.ones((batch.num_rows, 1))
        if len(self.labels) == 2:
            return np.column_stack([1 - p[:, 0], p[:, 0]])
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)


def features(batch: pa.RecordBatch, column: str, sizes: tuple[int, ...], bits: int, fold: bool, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hashed n-gram), those in ``used`` if given.

    ``fold`` lower-cases letters and turns all else into spaces, so that n-grams see where words begin.
    """
    found = []
    for chars, at, _, _ in characters(batch, column, max(sizes) - 1):
        if fold:
            chars = np.where(letter_table()[chars], lower_table()[chars], np.uint32(32))
        rows, buckets = hashed(chars, at, sizes, bits)
        if used is not None:
            hit = np.flatnonzero(used[buckets])
            rows, buckets = rows[hit], buckets[hit]
        found.append(distinct(rows, buckets, bits))
    if len(found) == 1:
        return found[0]
    return distinct(*(np.concatenate(x) for x in zip(*found, strict=True)), bits)


def fit_weights(lens: np.ndarray, cols: np.ndarray, y: np.ndarray, ratio: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on binary rows scaled by ``ratio``, by full-batch Adam steps: a weight for each ratio, and the bias.

    Rows are lists of features on end, ``lens`` long; features whose ratio is 0 take no part.
    """
    rows = np.repeat(np.arange(len(y), dtype=np.int32), lens)[ratio[cols] != 0]
    cols = cols[ratio[cols] != 0]
    scaled = ratio[cols]
    n, m = len(y), len(ratio)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, first, second = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    w[m] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=scaled * w[cols], minlength=n) + w[m]
        g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
        slope = np.r_[np.bincount(cols, weights=scaled * g[rows], minlength=m) / n + ridge * w[:m], g.mean()]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        w -= 0.03 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w[:m] * ratio, float(w[m])


def labelled_sample(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_bytes: int = MAX_TRAINING_BYTES) -> DataFrame:
    """(text, label) of about ``max_rows`` labelled documents and ``max_bytes`` of text at most, written once.

    ``labels`` is (doc_id, label); a document with several labels has the largest, null labels
    don't count. The sample is the ids with the smallest hashes, so it is the same at every run; only
    these ids, a bounded number, are broadcast to the documents. Rows that share id and text count once. If ids repeat, or texts are
    long, so that there is still too much, the share with the smallest hashes of id and text that fits is taken.
    """
    ids = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    met = only(documents, "doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = met.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.any_value("text").alias("text"), F.any_value("label").alias("label"))
    rows = materialize(rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))))
    n, size = rows.agg(F.count("*"), F.sum("size")).first()
    share = min(1.0, max_rows / max(1, n), max_bytes / max(1, size or 0))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << 32)) < share * (1 << 32))
    return rows.select("text", F.col("label").cast("int").alias("label"))


def fit_labelled(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, **options: object) -> LinearText | None:
    """:func:`fit` on the :func:`labelled_sample`, whose tables are deleted."""
    before = written()
    model = fit(labelled_sample(documents, labels, max_rows), **options)
    release(documents.sparkSession, before)
    return model


def _summed(batches: Iterator[pa.RecordBatch], bits: int, lists: bool) -> dict[int, np.ndarray]:
    """How many rows of each label have each n-gram, and at the end how many rows there are: from rows' lists, or from partial sums."""
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        for label, found, counts in zip(*(held_by(batch, c).to_pylist() for c in ("label", "found", "counts")), strict=True):
            held = out.setdefault(label, np.zeros((1 << bits) + 1, np.int32))
            at = np.frombuffer(found, np.int32)
            held[at] += 1 if lists else np.frombuffer(counts, np.int32)
            if lists:
                held[-1] += 1
    return out


def fit(
    sample: DataFrame, sizes: tuple[int, ...] = (4, 5, 6), bits: int = 20, fold: bool = True, ridge: float = 5e-4, steps: int = 80, choice: Choice = Choice()
) -> LinearText | None:
    """Fit on the bounded sample (text, label); None without rows.

    Features are made where the rows are and written once. Their counts are summed in each task and then over the tasks (one
    array of 2^bits counts a label); n-grams that get no weight are dropped where the rows are, so the
    task that fits gathers the others only.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                r, c = features(part, "text", sizes, bits, fold)
                ends = np.searchsorted(r, np.arange(part.num_rows + 1))
                found = [c[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield _rows(held_by(part, "label").to_pylist(), found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, held in _summed(batches, bits, True).items():
            at = np.flatnonzero(held).astype(np.int32)
            yield _rows([label], [at.tobytes()], [held[at].tobytes()])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _summed(batches, bits, False)
        total = np.sum(list(held.values()), axis=0, dtype=np.int64) if held else None
        classes = sorted(held)
        for k in classes[-1:] if len(classes) <= 2 else classes:
            if len(classes) == 1:
                yield _rows([k], [b""], [b""])
                continue
            ratio = choice.ratios(held[k][:-1], total[:-1], int(held[k][-1]), int(total[-1]))
            at = np.flatnonzero(ratio).astype(np.int32)
            yield _rows([k], [at.tobytes()], [ratio[at].tobytes()])

    rows = "label int, found binary, counts binary"
    found = materialize(sample.mapInArrow(extract, rows))
    chosen = {r["label"]: r for r in found.mapInArrow(count, rows).repartition(1).mapInArrow(choose, rows).collect()}
    if not chosen:
        return None
    classes = tuple(sorted(r[0] for r in found.select("label").distinct().collect()))
    ratios = {k: (np.frombuffer(r["found"], np.int32), np.frombuffer(r["counts"])) for k, r in chosen.items()}
    kept = np.unique(np.concatenate([at for at, _ in ratios.values()])).astype(np.int64)
    shared = sample.sparkSession.sparkContext.broadcast((kept, ratios))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << bits, -1, np.int32)
        place[shared.value[0]] = np.arange(len(shared.value[0]), dtype=np.int32)
        for batch in batches:
            places = [place[np.frombuffer(x, np.int32)] for x in held_by(batch, "found").to_pylist()]
            yield _rows(held_by(batch, "label").to_pylist(), [p[p >= 0].tobytes() for p in places])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, lens, labels = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
        for batch in batches:
            data, at = utf8(batch, "found")
            cols.append(np.frombuffer(data.tobytes(), np.int32))
            lens.append(np.diff(at) // 4)
            labels += held_by(batch, "label").to_pylist()
        kept, ratios = shared.value
        for k, (at, ratio) in ratios.items():
            full = np.zeros(len(kept))
            full[np.searchsorted(kept, at)] = ratio
            if len(classes) == 1:
                yield _rows([k], [full.tobytes()], [np.zeros(1).tobytes()])
                continue
            w, b = fit_weights(np.concatenate(lens), np.concatenate(cols), (np.array(labels) == k).astype(float), full, ridge, steps)
            yield _rows([k], [w.tobytes()], [np.array([b]).tobytes()])

    fitted = sorted(found.mapInArrow(prune, rows).repartition(1).mapInArrow(run, rows).collect(), key=lambda r: r["label"])
    weights = np.zeros((len(fitted), 1 << bits), np.float32)
    for k, r in enumerate(fitted):
        weights[k, kept] = np.frombuffer(r["found"])
    return LinearText(classes, sizes, bits, fold, weights, np.array([np.frombuffer(r["counts"])[0] for r in fitted]))


def _rows(labels: list[int], found: list[bytes], counts: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(found, pa.binary()), pa.array(counts or [None] * len(labels), pa.binary())], ["label", "found", "counts"])


def predict(documents: DataFrame, model: LinearText | None, text: str = "text") -> DataFrame:
    """All columns of ``documents`` and ``posteriors`` (array<double>, in the order of the model's labels).

    Null and empty texts have no n-gram: their posteriors follow the bias alone. Without a model
    every row's posteriors are an empty array. A column of that name in the input is replaced.
    """
    documents = documents.drop("posteriors")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    plain = documents.toDF(*(f"c{i}" for i in range(len(names))))
    at = f"c{names.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, at):
                p = model.posteriors(part, at) if model else np.zeros((part.num_rows, 0))
                flat = pa.array(p.ravel(), pa.float64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * p.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "posteriors"])

    schema = T.StructType([*plain.schema.fields, T.StructField("posteriors", T.ArrayType(T.DoubleType()))])
    return plain.mapInArrow(run, schema).toDF(*names, "posteriors")
