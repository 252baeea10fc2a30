"""Hard negatives for contrastive training by full score sorts.

Anchors go over the rows in chunks of bounded bytes that are broadcast. A task sorts, for each anchor, all its scores of a block of rows by
score and id, finds each positive's upper limit by binary search and reads the next rows of other labels while they are above the
lower limit. What blocks have found is merged: the best of all blocks are among the best of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, only, settled, written
from .vectors import by_length, products, whole_vector

#: Rows of one block, bytes of the anchors' vectors that are broadcast together, and scores that are sorted together.
BLOCK_ROWS, CHUNK_BYTES, STRIP = 8192, 16 << 20, 1 << 21


def rows_of(embeddings: DataFrame, scale: int, relabel: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, written; one row an id."""
    rows = only(embeddings, "vec_id", "label", "embedding")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole_vector(F.col("embedding"), scale).alias("v")).where("vec_id is not null and label is not null and v is not null")
    if relabel:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = materialize(rows)
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = materialize(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"))
    return rows


def blocks_of(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of blocks of rows of one length of vector, in order of the id."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for size, (own, grid) in by_length(batch.column(2)).items():
            held.setdefault(size, []).append((ids[own], labels[own], grid))
        for size in [s for s, parts in held.items() if sum(len(p[0]) for p in parts) >= block_rows]:
            yield _ordered(held.pop(size))
    for parts in held.values():
        yield _ordered(parts)


def _ordered(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, grid = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(ids, kind="stable")
    return ids[order], labels[order], grid[order].astype(np.int64)


def sorted_scores(vectors: np.ndarray, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor's number, order, scores in that order) for each anchor: all scores of a block, higher first.

    The block is in order of the id, so a stable sort by the score leaves ties in that order.
    """
    step = max(1, STRIP // max(1, len(vectors)))
    for begin in range(0, len(anchors), step):
        for i, scores in enumerate(products(anchors[begin : begin + step], vectors)):
            order = np.argsort(-scores, kind="stable")
            yield begin + i, order, scores[order]


def first_positives(ids: np.ndarray, labels: np.ndarray, own: int, label: int, order: np.ndarray, n: int) -> np.ndarray:
    """Places in ``order`` of the first n other rows of the anchor's label."""
    return np.flatnonzero((labels[order] == label) & (ids[order] != own))[:n]


def negatives_below(scores: np.ndarray, other: np.ndarray, positive: int, percent: int, k: int) -> np.ndarray:
    """Of ``other``, the places of rows of other labels in the sorted ``scores``: the first k with percent * positive <= 100 * score <= 100 * positive."""
    falling = -scores[other]
    begin = int(np.searchsorted(falling, -positive, side="left"))
    some = other[begin : begin + k]
    return some[[100 * int(s) >= percent * positive for s in scores[some]]]  # whole numbers of Python: no overflow


def _chunks(anchors: DataFrame, chunk_bytes: int) -> Iterator[DataFrame]:
    """The anchors in parts of about ``chunk_bytes`` of vectors, by hash of the id."""
    size = anchors.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0
    parts = max(1, -(-size // chunk_bytes))
    for c in range(parts):
        yield anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == c) if parts > 1 else anchors


def _best(found: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def _scan(rows: DataFrame, block_rows: int, chunk: list, look: Callable, names: list[str], keep: Callable) -> DataFrame:
    """One pass over all rows for one chunk of anchors (vec_id, label, v, positives): ``look`` gives columns for one anchor in one block, ``keep`` those worth keeping in a task."""
    spark = rows.sparkSession
    groups: dict[int, list] = {}
    for r in chunk:
        groups.setdefault(len(r["v"]), []).append(r)
    packed = {size: (np.array([r["v"] for r in own], np.int64).reshape(len(own), size), [tuple(r)[:2] + tuple(r)[3:] for r in own]) for size, own in groups.items()}
    shared = spark.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for ids, labels, grid in blocks_of(batches, block_rows):
            vectors, facts = shared.value.get(grid.shape[1], (np.zeros((0, grid.shape[1]), np.int64), []))
            found = [row for i, order, scores in sorted_scores(grid, vectors) for row in look(facts[i], ids, labels, order, scores)]
            if found:
                kept = [keep(np.concatenate([*kept, np.array(found, np.int64)]))]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept[0].T], names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _keeper(keys: int, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Of rows (key columns, score, id), those of the n best of each key: higher scores first, ties by smaller id."""

    def keep(found: np.ndarray) -> np.ndarray:
        found = found[np.lexsort((found[:, keys + 1], -found[:, keys], *found[:, :keys].T[::-1]))]
        new = np.r_[True, (found[1:, :keys] != found[:-1, :keys]).any(axis=1)]
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        return found[np.arange(len(found)) - begin < n]

    return keep


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, k: int = 5, percent: int = 80, scale: int = 256, relabel: int = 0, block_rows: int = BLOCK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    ``embeddings``: vec_id, label, embedding. Components become floor(scale * x); a score is the whole inner product with the anchor. Anchors are
    the rows whose id is divisible by ``every``. An anchor's positives are its ``positives`` best other rows of the same label; a
    positive's negatives are the k best rows of other labels with percent * positive score <= 100 * score <= 100 * positive score. Ties
    go to smaller ids. A positive of negative score, or one without rows in that range, gives no row.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part; nor do vectors whose whole numbers have a
    squared norm of 2^60 or more. Rows that repeat an id count once, the one with the smallest label and vector. Vectors meet those of
    their own length. With ``relabel``, ids divisible by it get the label (label + 1) % 10 first. Empty tables give empty
    results; further columns are ignored.

    Rows stay where they are: each of two passes (positives, negatives) reads the table once for every ``chunk_bytes`` of
    anchors, and a task keeps the best few of each anchor, so what is shuffled grows with anchors and tasks. The anchors' vectors of one chunk are
    all that is broadcast.
    """
    since = written()
    rows = rows_of(embeddings, scale, relabel)
    n = rows.count()
    spread = rows.coalesce(max(1, -(-n // block_rows)))  # fewer, fuller tasks: each returns rows for every anchor
    anchors = materialize(rows.where(F.col("vec_id") % every == 0))
    out = None
    for chunk in _chunks(anchors, chunk_bytes):
        asked = chunk.select("vec_id", "label", "v").collect()  # about chunk_bytes

        def look_positive(fact: tuple, ids: np.ndarray, labels: np.ndarray, order: np.ndarray, scores: np.ndarray) -> list:
            at = first_positives(ids, labels, fact[0], fact[1], order, positives)
            return [(fact[0], s, i) for s, i in zip(scores[at].tolist(), ids[order[at]].tolist(), strict=True)]

        found = materialize(_scan(spread, block_rows, asked, look_positive, ["anchor_id", "score", "other"], _keeper(1, positives)))
        chosen = materialize(_best(found, ["anchor_id"], [F.desc("score"), "other"], positives).select("anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
        scores_of = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score"), False).alias("positives"))  # ``positives`` values at most
        wanted = chunk.join(scores_of, chunk["vec_id"] == scores_of["anchor_id"]).select("vec_id", "label", "v", "positives").collect()

        def look_negative(fact: tuple, ids: np.ndarray, labels: np.ndarray, order: np.ndarray, scores: np.ndarray) -> list:
            other = np.flatnonzero(labels[order] != fact[1])
            out: list = []
            for positive in fact[2]:
                at = negatives_below(scores, other, positive, percent, k)
                out += [(fact[0], positive, s, i) for s, i in zip(scores[at].tolist(), ids[order[at]].tolist(), strict=True)]
            return out

        found = materialize(_scan(spread, block_rows, wanted, look_negative, ["anchor_id", "positive_score", "negative_score", "negative_id"], _keeper(2, k)))
        best = _best(found, ["anchor_id", "positive_score"], [F.desc("negative_score"), "negative_id"], k)
        part = materialize(chosen.join(best, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        out = part if out is None else out.unionByName(part)
    return settled(out, since)
