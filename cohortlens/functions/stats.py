"""Statistics as column expressions over counts, means and variances that an aggregate has made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P_FLOOR = 1e-16
Z95 = 1.96
#: Abramowitz and Stegun 7.1.26: fixed values.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def lenient_number(x: Column) -> Column:
    """A text as double; blank, text that is no number, NaN and null are 0."""
    y = F.when(F.trim(x).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(x)).try_cast("double")
    return F.coalesce(F.nanvl(y, F.lit(0.0)), F.lit(0.0))


def log1p_scale(x: Column) -> Column:
    """log(1 + x) of a measurement; negative, missing and NaN count as 0."""
    return F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def mean0(x: Column) -> Column:
    """Mean, 0 for no rows."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def std0(x: Column) -> Column:
    """Standard deviation with n-1, 0 for fewer than two rows."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def sigmoid(z: Column, limit: float = 35.0) -> Column:
    """1 / (1 + exp(-z)), exactly 0 and 1 beyond the limit."""
    return F.when(z < -limit, 0.0).when(z > limit, 1.0).otherwise(1 / (1 + F.exp(-z)))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by the five-term approximation; published p-values depend on it."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(ERF_A[4])
    for a in ERF_A[3::-1]:
        poly = poly * t + a
    erf = 1 - poly * t * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf))


def auc_from_ranks(rank_sum: Column, positives: Column, negatives: Column) -> Column:
    """AUC from the sum of the positives' average ranks; 0.5 pairs for ties are in the ranks."""
    return (rank_sum - positives * (positives + 1) / 2) / F.greatest(F.lit(1.0), positives * negatives)


def auc_standard_error(auc: Column, n1: Column, n0: Column) -> Column:
    """Hanley-McNeil; an AUC of 0 or 1 is first moved in by half a pair."""
    pairs = F.greatest(F.lit(1.0), n1 * n0)
    a = F.when((auc <= 0) | (auc >= 1), (auc * pairs + 0.5) / (pairs + 1)).otherwise(auc)
    q1 = a / F.greatest(F.lit(1e-12), 2 - a)
    q2 = 2 * a * a / F.greatest(F.lit(1e-12), 1 + a)
    return F.sqrt(F.greatest(F.lit(0.0), (a * (1 - a) + (n1 - 1) * (q1 - a * a) + (n0 - 1) * (q2 - a * a)) / pairs))


def auc_p_value(auc: Column, n1: Column, n0: Column) -> Column:
    """One-sided p-value of AUC > 0.5 from the null variance of ranks, not below the floor."""
    se = F.sqrt((n1 + n0 + 1) / F.greatest(F.lit(1.0), 12 * n1 * n0))
    return F.greatest(F.lit(P_FLOOR), F.least(F.lit(1.0), 1 - normal_cdf(F.when(se > 0, (auc - 0.5) / se).otherwise(0.0))))


def hedges_g(m1: Column, s1: Column, n1: Column, m0: Column, s0: Column, n0: Column, floor: int = 4) -> Column:
    """Standardised mean difference with the small-sample correction 1 - 3 / max(floor, 4N - 9); 0 without spread."""
    df = F.greatest(F.lit(1.0), n1 + n0 - 2)
    pooled = F.sqrt(F.greatest(F.lit(0.0), ((n1 - 1) * s1 * s1 + (n0 - 1) * s0 * s0) / df))
    correction = 1 - 3 / F.greatest(F.lit(float(floor)), 4 * (n1 + n0) - 9)
    return F.when((pooled > 0) & (n1 + n0 > 2), correction * (m1 - m0) / F.when(pooled > 0, pooled).otherwise(1.0)).otherwise(0.0)


def cohen_d(m1: Column, s1: Column, m0: Column, s0: Column) -> Column:
    """Mean difference over the root of the mean variance (1 where that is 0)."""
    pooled = F.sqrt((s1 * s1 + s0 * s0) / 2)
    return (m1 - m0) / F.when(pooled > 0, pooled).otherwise(1.0)


def welch_error(s1: Column, n1: Column, s0: Column, n0: Column) -> Column:
    return F.sqrt(s1 * s1 / F.greatest(F.lit(1.0), n1) + s0 * s0 / F.greatest(F.lit(1.0), n0))


def log2_fold_change(m1: Column, m0: Column, log_scale: bool = False) -> Column:
    """log2((m1+1)/(m0+1)) of linear means; their difference on a log2 scale."""
    return m1 - m0 if log_scale else F.log2((m1 + 1) / (m0 + 1))


def f1_counts(tp: Column, fp: Column, fn: Column) -> Column:
    return 2 * tp / F.greatest(F.lit(1), 2 * tp + fp + fn)
