"""Wide and transposed matrices as long rows, and per-sample or per-feature derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_long(wide: DataFrame, ids: list[str], features: list[str] | None = None) -> DataFrame:
    """(ids, feature, value) from one column per feature; all columns but the ids by default."""
    features = features or [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, features, "feature", "value")


def explode_vector(df: DataFrame, ids: list[Column | str], vector: str, scale: str = "double") -> DataFrame:
    """(ids, feature, value) from an array column; feature is the position from 0."""
    return df.select(*ids, F.posexplode(vector).alias("feature", "value")).withColumn("value", F.col("value").cast(scale))


def project(df: DataFrame, required: list[str], show: int = 20) -> DataFrame:
    """The required columns; a missing one is an error that lists the first of them."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{len(missing)} columns are missing: {', '.join(missing[:show])}")
    return df.select(*(F.col(f"`{c}`") for c in required))


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of both, in the order of the first."""
    other = set(b.columns)
    return [c for c in a.columns if c in other]


def slice_columns(df: DataFrame, first: int, count: int) -> DataFrame:
    """The id column and ``count`` columns from position ``first`` (1 is the first after the id)."""
    return df.select(*(F.col(f"`{c}`") for c in [df.columns[0], *df.columns[first : first + count]]))


def center_by_sample(long: DataFrame, sample: str = "sample", value: str = "value") -> DataFrame:
    """Each value minus the mean of all of its sample's features; prune features only afterwards."""
    return long.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(sample)))


def row_mean(long: DataFrame, mapping: DataFrame, sample: str = "sample", feature: str = "feature", value: str = "value") -> DataFrame:
    """(sample, entity, value): mean over the entity's mapped features; missing numbers are 0 and count.

    ``mapping`` is (feature, entity). Features that a sample lacks altogether count as 0 too.
    """
    sizes = mapping.groupBy("entity").agg(F.count_distinct(feature).alias("k"))
    sums = long.join(mapping, feature).groupBy(sample, "entity").agg(F.sum(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))).alias("s"))
    return sums.join(sizes, "entity").select(sample, "entity", (F.col("s") / F.col("k")).alias("value"))


def standardize(long: DataFrame, train: Column, feature: str = "feature", value: str = "value") -> DataFrame:
    """(x - mean) / sd with both from the training rows alone; sd 0 counts as 1."""
    fit = long.where(train).groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    sd = F.when(F.coalesce("_s", F.lit(0.0)) > 0, F.col("_s")).otherwise(1.0)
    return long.join(fit, feature).withColumn("z", (F.col(value) - F.col("_m")) / sd).drop("_m", "_s")


def transpose_sum(long: DataFrame, mapping: DataFrame, row: str, sample: str, value: str) -> DataFrame:
    """(sample, feature, value): rows mapped to features by ``mapping`` (row, feature), values of a feature summed; unmapped rows go."""
    return long.join(mapping, row).groupBy(sample, "feature").agg(F.sum(value).alias("value"))


def class_profile(long: DataFrame, feature: str = "feature", label: str = "label", value: str = "value") -> DataFrame:
    """Per feature: counts, means and deviations of cases and controls, and shares of positive values."""
    case, control = F.col(label) == 1, F.col(label) == 0
    return long.groupBy(feature).agg(
        F.count_if(case).cast("double").alias("n1"), F.count_if(control).cast("double").alias("n0"),
        F.avg(F.when(case, F.col(value))).alias("m1"), F.avg(F.when(control, F.col(value))).alias("m0"),
        F.coalesce(F.stddev_samp(F.when(case, F.col(value))), F.lit(0.0)).alias("s1"), F.coalesce(F.stddev_samp(F.when(control, F.col(value))), F.lit(0.0)).alias("s0"),
        (100 * F.avg(F.when(case, (F.col(value) > 0).cast("double")))).alias("detect1"), (100 * F.avg(F.when(control, (F.col(value) > 0).cast("double")))).alias("detect0"),
    )


def global_shift(profile: DataFrame) -> DataFrame:
    """One row: features higher, lower and equal in cases, the share higher, and seven quantiles of the differences."""
    d = F.col("m1") - F.col("m0")
    points = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    return profile.agg(
        F.count_if(d > 0).alias("higher"), F.count_if(d < 0).alias("lower"), F.count_if(d == 0).alias("equal"),
        (F.count_if(d > 0) / F.count("*")).alias("share_higher"), F.percentile(d, F.array(*map(F.lit, points))).alias("quantiles"),
    )
