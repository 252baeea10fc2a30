"""Contracts and expectation suites: each check is a query whose violations must be empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import global_rank


def header_contract(df: DataFrame, first: list[str]) -> None:
    """The first columns must have these names, and no name may occur twice."""
    if df.columns[: len(first)] != first:
        raise ValueError(f"the first columns must be {first}, found {df.columns[: len(first)]}")
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("column names repeat")


def duplicates(df: DataFrame, key: str, fold_case: bool = False) -> DataFrame:
    k = F.lower(F.trim(F.col(key).cast("string"))) if fold_case else F.col(key)
    return df.groupBy(k.alias(key)).agg(F.count("*").alias("n")).where("n > 1")


def label_violations(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is neither 0 nor 1."""
    return df.where(F.col(label).isNull() | ~F.col(label).isin(0, 1))


def numeric_violations(long: DataFrame, value: str, linear: bool = True) -> DataFrame:
    """Values that are missing, not finite, or negative on a linear scale."""
    x = F.col(value).try_cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return long.where(bad | (x < 0) if linear else bad)


def group_sizes(df: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Labels of fewer than ``least`` rows, of the two there must be."""
    wanted = df.sparkSession.createDataFrame([(0,), (1,)], "label int")
    sizes = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    return wanted.join(sizes, "label", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < least)


def tolerance_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 0.000051) -> DataFrame:
    """One row: cells compared, cells missing in b, cells beyond the tolerance, largest difference."""
    met = a.join(b.withColumnRenamed(value, "_b"), keys, "left")
    d = F.abs(F.col(value) - F.col("_b"))
    return met.agg(F.count("*").alias("cells"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(d > tolerance).alias("beyond"), F.max(d).alias("largest"))


def rank_violations(df: DataFrame, rank: str, score: str | None = None, by: list[str] | None = None, slack: float = 1e-12) -> DataFrame:
    """Rows where ranks are not 1, 2, 3 ... or a score rises from one rank to the next, within ``by`` or in the whole frame."""
    if by:
        w = Window.partitionBy(*by).orderBy(rank)
        out = df.withColumn("_at", F.row_number().over(w)).withColumn("_prior", F.lag(score or rank).over(w))
    else:  # neighbours meet by their number
        numbered = global_rank(df, [rank, *([score] if score else [])], "_at")
        prior = numbered.select((F.col("_at") + 1).alias("_at"), F.col(score or rank).alias("_prior"))
        out = numbered.join(prior, "_at", "left")
    bad = F.col("_at") != F.col(rank)
    if score:
        bad = bad | F.coalesce(F.col(score) > F.col("_prior") + slack, F.lit(False))
    return out.where(bad).select(*(f"`{c}`" for c in df.columns))


def same_frame(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def contained(keys: list[str], known: DataFrame, column: str) -> list[str]:
    """Keys that the known column lacks; the list is a constant of the caller."""
    wanted = known.sparkSession.createDataFrame([(k,) for k in keys], f"{column} string")
    return [r[0] for r in wanted.join(known.select(column), column, "left_anti").orderBy(column).collect()]


def suite(spark: SparkSession, checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations, passed) for named violation queries."""
    rows = [df.agg(F.lit(name).alias("check"), F.count("*").alias("violations")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("violations") == 0)


def fused_suite(tables: dict[str, DataFrame], rows: dict[str, tuple[str, str]], keys: dict[str, tuple[str, list[str]]] | None = None, references: dict[str, tuple[str, str, str, str]] | None = None) -> DataFrame:
    """(check, table, checked, violations, passed): expectations over several tables, fused so that a table is scanned once for all its row checks.

    ``rows``: name to (table, violation as SQL over its columns; a violation that is null is none). ``keys``: name to (table, columns), which
    must not repeat; the surplus rows are violations, nulls are values like others. ``references``: name to (table, column, other table, other column): rows
    whose value the other lacks; nulls refer to nothing. Row checks are one aggregate a table; keys are counted, references anti-joined.
    """
    parts = []
    for table in dict.fromkeys(t for t, _ in rows.values()):
        own = {name: v for name, (t, v) in rows.items() if t == table}
        one = tables[table].agg(F.count("*").alias("checked"), *(F.count_if(F.expr(v)).alias(f"v{i}") for i, v in enumerate(own.values())))
        each = F.array(*(F.struct(F.lit(name).alias("check"), F.col(f"v{i}").alias("violations")) for i, name in enumerate(own)))
        parts.append(one.select("checked", F.explode(each).alias("c")).select("c.check", F.lit(table).alias("table"), "checked", "c.violations"))
    for name, (table, columns) in (keys or {}).items():
        counts = tables[table].groupBy(*columns).agg(F.count("*").alias("n"))
        sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        parts.append(sums.select(F.lit(name).alias("check"), F.lit(table).alias("table"), "checked", "violations"))
    for name, (table, column, other, known) in (references or {}).items():
        values = tables[table].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("n"))  # hot values are one row
        held = tables[other].select(F.col(known).alias("_k"), F.lit(True).alias("_held")).where("_k is not null").distinct()
        met = values.join(held, "_k", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.coalesce(F.sum(F.when(F.col("_held").isNull(), F.col("n"))), F.lit(0)).alias("violations"))
        parts.append(met.select(F.lit(name).alias("check"), F.lit(table).alias("table"), "checked", "violations"))
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)
