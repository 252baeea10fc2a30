"""Evidence scores, weights, labels and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expression_score(auc: Column, log2fc: Column, detection_gap: Column) -> Column:
    """0.6 for separation either way, 0.3 for fold change, 0.1 for detection; each term from 0 to 1."""
    folded = F.greatest(auc, 1 - auc)
    return 0.6 * F.greatest(F.lit(0.0), (folded - 0.5) * 2) + 0.3 * F.least(F.lit(1.0), F.abs(log2fc) / 3) + 0.1 * F.least(F.lit(1.0), F.abs(detection_gap) / 50)


def validation_score(cv_auc: Column, log2fc: Column, detection_gap: Column) -> Column:
    """0.7 for cross-validated AUC above 0.5, 0.2 for fold change, 0.1 for detection."""
    return 0.7 * F.greatest(F.lit(0.0), (cv_auc - 0.5) * 2) + 0.2 * F.least(F.lit(1.0), F.abs(log2fc) / 3) + 0.1 * F.least(F.lit(1.0), F.abs(detection_gap) / 50)


def blend(*parts: tuple[float, Column]) -> Column:
    """Weighted sum, as in 0.45/0.45/0.10, 0.5/0.5, 0.75/0.25 and 0.25/0.75."""
    total = F.lit(0.0)
    for weight, score in parts:
        total = total + weight * score
    return total


def sequence_score(centroid: Column, nearest: Column, motifs: Column, seed: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * centroid + 0.25 * nearest + 0.15 * motifs + 0.1 * seed))


def direction_from_fold_change(log2fc: Column, dead: float = 0.05) -> Column:
    return F.when(log2fc > dead, "higher").when(log2fc < -dead, "lower").otherwise("none")


def direction_from_weight(w: Column) -> Column:
    return F.when(w > 0, "higher").when(w < 0, "lower").otherwise("none")


def marker_weight(priority: Column) -> Column:
    """alta 3, media and painel_inicial 2, anything else 1."""
    p = F.lower(F.trim(F.coalesce(priority, F.lit(""))))
    return F.when(p == "alta", 3.0).when(p.isin("media", "painel_inicial"), 2.0).otherwise(1.0)


def evidence_weight(explicit: Column) -> Column:
    """An explicit weight if finite and positive, else 1."""
    return F.coalesce(F.when((explicit > 0) & ~F.isnan(explicit) & (explicit < float("inf")), explicit), F.lit(1.0))


def directional(value: Column, direction: Column, lower: str = "lower", flip_from: float | None = None) -> Column:
    """The value seen from the expected direction: turned around only where that is ``lower``; no direction counts as higher."""
    flipped = -value if flip_from is None else flip_from - value
    return F.when(direction.eqNullSafe(lower), flipped).otherwise(value)


def replicated(n1: Column, n0: Column, concordant: Column, ci_low: Column, fdr: Column, least: int = 10) -> Column:
    return (n1 >= least) & (n0 >= least) & concordant & (ci_low > 0.5) & (fdr < 0.05)


def parse_pairs(x: Column) -> Column:
    """``a:0.8; b:0.7`` as an array of (marker, similarity)."""
    items = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(items, lambda s: F.struct(F.trim(F.split_part(s, F.lit(":"), F.lit(1))).alias("marker"), F.split_part(s, F.lit(":"), F.lit(2)).try_cast("double").alias("similarity")))
