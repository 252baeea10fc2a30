"""Toxicity: the character n-gram linear classifier of :mod:`linear_text` on ``labels.toxic``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear_text
from .common import only

THRESHOLD = 0.5


def fit_toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = linear_text.MAX_TRAINING_ROWS) -> linear_text.LinearText | None:
    """Learn from the documents that ``labels`` (doc_id, toxic) marks, at most ``max_rows`` of them."""
    return linear_text.fit_labelled(documents, only(labels, "doc_id", "toxic").withColumnRenamed("toxic", "label"), max_rows)


def score_toxicity(documents: DataFrame, model: linear_text.LinearText | None, text: str = "text") -> DataFrame:
    """All columns of ``documents`` and ``toxic_score`` from 0 to 1.

    Null and empty texts get the score of the bias alone; equal texts get equal scores. Without a
    model (no labelled row) every score is 0. Repeated rows stay; a column of that name in the input is replaced.
    """
    scored = linear_text.predict(documents.drop("toxic_score"), model, text)
    if model is not None and 1 in model.labels:
        p = F.element_at("posteriors", model.labels.index(1) + 1)
    else:
        p = F.lit(0.0)
    return scored.withColumn("toxic_score", p).drop("posteriors")
