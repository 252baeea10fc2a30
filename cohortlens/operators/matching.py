"""Joins with checks and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_either(rows: DataFrame, features: DataFrame, row_key: str, feature_keys: list[Column]) -> DataFrame:
    """Rows with each feature that one of its keys matches, once: keys are exploded, so the join stays an equi-join."""
    keys = features.withColumn("_key", F.explode(F.array_distinct(F.array(*feature_keys))))
    return rows.join(keys, rows[row_key] == keys["_key"]).drop("_key").distinct()


def one_to_one(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(joined, violations): violations are (key, problem) for duplicates on a side, and keys missing or unused."""
    na, nb = a.groupBy(key).agg(F.count("*").alias("_a")), b.groupBy(key).agg(F.count("*").alias("_b"))
    both = na.join(nb, key, "full_outer")
    problem = (
        F.when(F.col("_a") > 1, "duplicate on the left").when(F.col("_b") > 1, "duplicate on the right")
        .when(F.col("_b").isNull(), "missing on the right").when(F.col("_a").isNull(), "unused on the right")
    )
    return a.join(b, key), both.select(key, problem.alias("problem")).where("problem is not null")


def exact_or_family(left: DataFrame, entries: DataFrame, name: str, family: str, preference: Column, keep: str) -> DataFrame:
    """Left rows with the entry of their exact name, else of their family by ``preference`` (smaller first); ``method`` says which.

    Entries are (name, family, keep, ...); ``keep`` is the column that is returned as ``resolved``.
    """
    exact = entries.select(F.col(name), F.col(keep).alias("_exact")).dropDuplicates([name])
    w = Window.partitionBy(family).orderBy(preference, keep)
    best = entries.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(F.col(family), F.col(keep).alias("_family"))
    met = left.join(exact, name, "left").join(best, family, "left")
    method = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_family").isNotNull(), "family").otherwise("absent")
    return met.withColumn("resolved", F.coalesce("_exact", "_family")).withColumn("method", method).drop("_exact", "_family")


def exact_or_all_family(left: DataFrame, columns: DataFrame, name: str, family: str) -> DataFrame:
    """Left rows with the list of columns that stand for them: the exact one, else all of the family, else none."""
    exact = columns.select(F.col("column").alias("_exact"), F.col(name)).dropDuplicates([name])
    wide = columns.groupBy(family).agg(F.sort_array(F.collect_set("column")).alias("_family"))
    met = left.join(exact, name, "left").join(wide, family, "left")
    resolved = F.when(F.col("_exact").isNotNull(), F.array("_exact")).otherwise(F.coalesce("_family", F.array().cast("array<string>")))
    method = F.when(F.col("_exact").isNotNull(), "exact").when(F.size("_family") > 0, "family").otherwise("absent")
    return met.withColumn("columns", resolved).withColumn("method", method).drop("_exact", "_family")


def with_default(left: DataFrame, right: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left outer join with defaults for what is missing."""
    out = left.join(right, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def disjoint_violations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys (trimmed, lower case) that both have."""
    norm = F.lower(F.trim(F.col(key).cast("string"))).alias(key)
    return a.select(norm).distinct().join(b.select(norm).distinct(), key, "left_semi")


def explode_list(df: DataFrame, column: str, separator: str = ";", name: str = "item") -> DataFrame:
    """One row for each trimmed, non-empty item of a delimited cell."""
    items = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), separator), lambda s: F.trim(s)), lambda s: s != "")
    return df.withColumn(name, F.explode(items))
