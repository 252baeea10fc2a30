"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its three letters: the first one's vector
rotated twice, the second's rotated once and the third's are multiplied. A document bundles
(adds) the vectors of its trigrams, a language bundles its documents, and a document has the
language whose bundle is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_by, materialize, mix64, only, slices
from .ngrams import characters, letter_table, lower_table

DIMENSIONS = 1024
#: Documents learned from are about this many per language, those with the smallest hashes.
MAX_TRAINING_ROWS_PER_LANGUAGE = 1000
SEED = np.uint64(20240229)
#: Elements of the largest temporary matrix.
CELLS = 1 << 21


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """(letters, DIMENSIONS) of +1 and -1: each code point's own random vector, from a seeded hash; 0 stands for what is no letter."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)[None, :]
    bits = mix64(mix64(letters.astype(np.uint64)[:, None] ^ SEED) + (words + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _trigrams(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, trigram) of every letter of a slice: the letter and its neighbours, in 21 bits each."""
    for chars, at, lead, tail in characters(batch, column, 1):
        s = np.where(letter_table()[chars], lower_table()[chars], np.uint32(0)).astype(np.int64)
        before, after = np.zeros_like(s), np.zeros_like(s)
        before[1:], after[:-1] = s[:-1], s[1:]
        some = np.flatnonzero(np.diff(at) > 0)
        before[at[some]] = 0
        after[at[some + 1] - 1] = 0
        mid = s > 0
        mid[:lead] = False
        mid[len(mid) - tail :] = False
        yield np.repeat(np.arange(batch.num_rows), np.diff(at))[mid], ((before << 42) | (s << 21) | after)[mid]


def bundles(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """(rows, DIMENSIONS): each text's bundle; zeros where a text is null or has no letter.

    The trigrams of a letter are it and its neighbours; what is no letter counts as one more letter. Trigrams are counted by row
    and kind (sparse); blocks of rows whose kinds fill a matrix well are multiplied, others are summed kind by kind.
    """
    out = np.zeros((batch.num_rows, DIMENSIONS), np.float32)
    for rows, codes in _trigrams(batch, column):
        if not len(rows):
            continue
        kinds, place = np.unique(codes, return_inverse=True)
        letters, parts = np.unique(np.concatenate([kinds >> 42, (kinds >> 21) & 0x1FFFFF, kinds & 0x1FFFFF]), return_inverse=True)
        v, (first, second, third) = letter_vectors(letters), parts.reshape(3, -1)

        def bound(k: np.ndarray) -> np.ndarray:
            return np.roll(v, 2, axis=1)[first[k]] * np.roll(v, 1, axis=1)[second[k]] * v[third[k]]

        pair, count = np.unique(rows * len(kinds) + place, return_counts=True)
        rows, place = pair // len(kinds), pair % len(kinds)
        lo, hi = int(rows[0]), int(rows[-1]) + 1
        if len(pair) < 0.04 * (hi - lo) * len(kinds):  # many short rows: each has few of the kinds
            step = CELLS // DIMENSIONS
            for c in range(0, len(pair), step):
                r, part = rows[c : c + step], bound(place[c : c + step]) * count[c : c + step, None].astype(np.float32)
                new = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                out[r[new]] += np.add.reduceat(part, new, axis=0)
            continue
        step = max(1, min(CELLS // DIMENSIONS, CELLS // (hi - lo)))
        order = np.argsort(place, kind="stable")
        rows, place, count = rows[order], place[order], count[order]
        for k in range(0, len(kinds), step):
            i, j = np.searchsorted(place, [k, k + step])
            dense = np.zeros((hi - lo, min(step, len(kinds) - k)), np.float32)
            dense[rows[i:j] - lo, place[i:j] - k] = count[i:j]
            out[lo:hi] += dense @ bound(np.arange(k, min(k + step, len(kinds)))).astype(np.float32)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    vectors: np.ndarray


def fit_profiles(documents: DataFrame, per_language: int = MAX_TRAINING_ROWS_PER_LANGUAGE) -> Profiles | None:
    """Language profiles from (doc_id, text, lang); rows of null lang teach nothing.

    Counting rows by language gives each one the share of its rows, by the hash of id and text, that makes about
    ``per_language`` rows: rare languages teach with all they have. Rows that share id and text are one. Any number of languages is
    learned, each a vector of 4 KB on the driver and in the workers. None without a row.
    """
    rows = only(documents, "doc_id", "text", "lang").where("lang is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    span = float(1 << 32)
    limits = counts.select("lang", F.least(F.lit(span), per_language / F.col("n") * span).alias("below"))
    h = F.xxhash64("doc_id", "text")
    met = rows.join(F.broadcast(materialize(limits)), "lang").where(F.pmod(h, F.lit(1 << 32)) < F.col("below"))
    sample = met.groupBy("doc_id", "lang", h.alias("h")).agg(F.any_value("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", max_rows=8192):
                unit = _unit(bundles(part, "text"))
                langs = np.array(held_by(part, "lang").to_pylist(), dtype=object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + unit[langs == lang].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "v"])

    # the sample is bounded: a few tasks bundle it, each returns one vector a language
    total: dict[str, np.ndarray] = {}
    for r in sample.repartition(6).mapInArrow(run, "lang string, v binary").collect():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["v"])
    langs = sorted(total)
    if not langs:
        return None
    return Profiles(tuple(langs), _unit(np.array([total[x] for x in langs])).astype(np.float32))


def predict_language(documents: DataFrame, profiles: Profiles | None, text: str = "text") -> DataFrame:
    """All columns of ``documents``, ``lang_pred`` and ``lang_score``.

    ``lang_pred`` is the language of the largest cosine (ties: the first by name), ``lang_score`` that cosine, 0
    if negative. Texts that are null or hold no letter, and all texts without profiles, are ``und`` with score 0.
    Repeated rows stay; columns of these names in the input are replaced.
    """
    documents = documents.drop("lang_pred", "lang_score")
    shared = documents.sparkSession.sparkContext.broadcast(profiles)
    names = documents.columns
    plain = documents.toDF(*(f"c{i}" for i in range(len(names))))
    at = f"c{names.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, at, max_rows=8192):
                if known is None:
                    best, pred = np.zeros(part.num_rows), ["und"] * part.num_rows
                else:
                    x = bundles(part, at)
                    cos = _unit(x) @ known.vectors.T
                    k = cos.round(6).argmax(axis=1)
                    some = x.any(axis=1)
                    best = np.where(some, np.clip(cos[np.arange(len(k)), k], 0, 1), 0).astype(float)
                    pred = [known.languages[i] if ok else "und" for i, ok in zip(k, some, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(best, pa.float64())], [*part.schema.names, "lang_pred", "lang_score"])

    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*names, "lang_pred", "lang_score")
