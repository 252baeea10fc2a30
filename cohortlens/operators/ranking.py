"""Ranks, AUC, false discovery rates, folds, bags, fronts and cut-offs.

Windows are partitioned by the feature or group. A global rank needs an order of all rows; :func:`global_rank`
makes it from a range-partitioned sort and per-partition offsets instead of a window on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.hashing import fnv1a
from ..storage import materialize


def average_rank(df: DataFrame, value: str, by: list[str], name: str = "average_rank") -> DataFrame:
    """Ranks from 1 in ascending order within ``by``; ties share their mean position."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)


def auc(long: DataFrame, by: list[str], label: str = "label", value: str = "value") -> DataFrame:
    """(by, auc, n1, n0): Mann-Whitney AUC with ties at one half; 0.5 pairs need no pair of rows.

    Values are counted first: the partial aggregate over (by, value) shrinks ties before anything is sorted, and
    the rank sum comes from running counts over distinct values.
    """
    counts = long.groupBy(*by, value).agg(F.count_if(F.col(label) == 1).alias("c1"), F.count_if(F.col(label) == 0).alias("c0"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("c0").over(before), F.lit(0))
    ranked = counts.withColumn("wins", F.col("c1") * (below + F.col("c0") / 2))
    out = ranked.groupBy(*by).agg(F.sum("wins").alias("wins"), F.sum("c1").cast("double").alias("n1"), F.sum("c0").cast("double").alias("n0"))
    return out.select(*by, (F.col("wins") / F.greatest(F.lit(1.0), F.col("n1") * F.col("n0"))).alias("auc"), "n1", "n0")


def auc_inference(aucs: DataFrame) -> DataFrame:
    """Adds standard_error, ci_low, ci_high and p_value to (auc, n1, n0)."""
    a, n1, n0 = F.col("auc"), F.col("n1"), F.col("n0")
    se = stats.auc_standard_error(a, n1, n0)
    return (
        aucs.withColumn("standard_error", se)
        .withColumn("ci_low", F.greatest(F.lit(0.0), a - stats.Z95 * F.col("standard_error")))
        .withColumn("ci_high", F.least(F.lit(1.0), a + stats.Z95 * F.col("standard_error")))
        .withColumn("p_value", stats.auc_p_value(a, n1, n0))
    )


def benjamini_hochberg(df: DataFrame, p: str = "p_value", by: list[str] | None = None, name: str = "fdr") -> DataFrame:
    """Adds the step-up false discovery rate, within ``by`` or over the whole frame; null p-values are no hypotheses and have none.

    Equal p-values have equal rates, so what is ordered are the distinct ones with their counts. Over a whole frame they are
    sorted by ranges: sums and minima within the ranges, and one row for each range to go on from. The rows are written first: rates
    come back by the p-value, and one that is computed twice, from sums of doubles in another order, may differ in its last bit.
    """
    if by:
        w = Window.partitionBy(*by)
        k = F.count(p).over(w.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
        ranked = df.withColumn("_q", F.least(F.lit(1.0), F.col(p) * F.count(p).over(w) / k))
        return ranked.withColumn(name, F.when(F.col(p).isNotNull(), F.min("_q").over(w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)))).drop("_q")
    df = materialize(df)
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    parts = materialize(counts.repartitionByRange("_p").withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part")
    whole = Window.orderBy("_part")  # one row a part
    sizes = parts.groupBy("_part").agg(F.sum("_c").alias("_size"))
    sizes = sizes.withColumn("_before", F.sum("_size").over(whole) - F.col("_size")).withColumn("_n", F.sum("_size").over(Window.partitionBy()))
    k = F.col("_before") + F.sum("_c").over(own.orderBy("_p"))
    rated = parts.join(F.broadcast(sizes), "_part").withColumn("_q", F.least(F.lit(1.0), F.col("_p") * F.col("_n") / k))
    least = rated.groupBy("_part").agg(F.min("_q").alias("_m")).withColumn("_after", F.min("_m").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)))
    q = F.min("_q").over(own.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))
    rates = rated.join(F.broadcast(least), "_part").select("_p", F.least(q, F.coalesce("_after", F.lit(1.0))).alias(name))
    return df.join(rates, df[p] == rates["_p"], "left").drop("_p")


def distinct_fdr(df: DataFrame, key: Column, p: str = "p_value") -> DataFrame:
    """The false discovery rate over distinct hypotheses, given back to all rows that share one."""
    keyed = df.withColumn("hypothesis", key)
    tested = benjamini_hochberg(keyed.groupBy("hypothesis").agg(F.min(p).alias(p)), p)
    shared = F.count("*").over(Window.partitionBy("hypothesis"))
    return keyed.join(tested.select("hypothesis", "fdr"), "hypothesis").withColumn("sharing", shared)


def sequential_rank(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Ranks 1, 2, 3 ... within ``by``, or of the whole frame; ``order`` must be total."""
    if not by:
        return global_rank(df, order, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Ranks 1..n over the whole frame without one task holding it: sort by ranges, number each part, add the parts before.

    ``order`` must be a total order (end it with a unique key). Range bounds come from samples, so the parts are
    written once: numbers and sizes must be of the same parts.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    numbered = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))  # one row a part
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_size", "_before")


def running_total(df: DataFrame, order: list[Column | str], value: str, name: str = "before") -> DataFrame:
    """The sum of ``value`` over all rows before, in a total order, by ranges as in :func:`global_rank`."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))  # one row a part
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    total = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    return parts.withColumn("_own", total).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def percentile_rank(df: DataFrame, order: list[Column], by: list[str], name: str = "percentile") -> DataFrame:
    """Position / (n - 1) in the given total order; a single row has 1."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumn(name, F.when(n == 1, 1.0).otherwise(at / F.greatest(n - 1, F.lit(1))))


def held_out_midrank(held: DataFrame, background: DataFrame, by: list[str], family: str | None = None) -> DataFrame:
    """Rank and percentile of each held-out score among the background: 1 + greater + tied / 2.

    Both have ``by`` columns and ``score``; with ``family``, background rows of the held-out row's own family don't count.
    Running counts over the distinct scores replace the product of both sides.
    """
    def counted(df: DataFrame, keys: list[str]) -> DataFrame:
        counts = df.groupBy(*keys, "score").agg(F.count_if(~F.col("_held")).alias("_c"), F.max(F.col("_held").cast("int")).alias("_h"))
        w = Window.partitionBy(*keys).orderBy(F.desc("score"))
        above = F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("_c").over(Window.partitionBy(*keys))
        return counts.select(*keys, "score", above.alias("greater"), F.col("_c").alias("tied"), total.alias("pool"), "_h").where("_h = 1").drop("_h")

    columns = [*by, "score", *([family] if family else [])]
    both = held.select(*columns).withColumn("_held", F.lit(True)).unionByName(background.select(*columns).withColumn("_held", F.lit(False)))
    out = held.join(counted(both, by), [*by, "score"])
    if family:
        own = counted(both, [*by, family]).withColumnsRenamed({"greater": "_g", "tied": "_t", "pool": "_p"})
        out = out.join(own, [*by, family, "score"]).withColumns(
            {"greater": F.col("greater") - F.col("_g"), "tied": F.col("tied") - F.col("_t"), "pool": F.col("pool") - F.col("_p")}
        ).drop("_g", "_t", "_p")
    worse = F.col("greater") + F.col("tied") / 2
    return out.withColumn("rank", 1 + worse).withColumn("percentile", 1 - worse / F.greatest(F.lit(1), F.col("pool")))


def recall_at(df: DataFrame, by: list[str], percentile: str = "percentile", cuts: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Count, mean percentile, and number and share of rows with percentile of at least 1 - cut / 100."""
    columns = [F.count("*").alias("n"), F.avg(percentile).alias("mean_percentile")]
    for c in cuts:
        hit = F.count_if(F.col(percentile) >= 1 - c / 100)
        columns += [hit.alias(f"recovered_{c}"), (hit / F.greatest(F.lit(1), F.count("*"))).alias(f"recall_{c}")]
    return df.groupBy(*by).agg(*columns)


def hash_folds(df: DataFrame, key: Column, folds: int, by: list[str] | None = None, salt: str = "", name: str = "fold") -> DataFrame:
    """Round-robin folds in the order of the hash of salt and key, then the key, within each class.

    Classes may be few and large, so the order is one over all rows; a row's place in its class is its rank less the class's first.
    """
    keyed = df.withColumn("_all", F.lit(0)).withColumn("_key", key).withColumn("_h", fnv1a(F.concat(F.lit(salt), F.col("_key"))))
    classes = by or ["_all"]
    ranked = global_rank(keyed, [*classes, "_h", "_key"], "_r")
    first = ranked.groupBy(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(classes))).agg(F.min("_r").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(classes)]
    return ranked.join(first, same).select(*(f"`{c}`" for c in df.columns), ((F.col("_r") - F.col("_first")) % folds).alias(name))


def hash_bags(df: DataFrame, key: str, bags: int, size: int, salt: str) -> DataFrame:
    """(bag, ...): for each bag the ``size`` rows with the smallest hashes of ``salt|bag|key``; all rows where there are no more."""
    tagged = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    order = [fnv1a(F.concat(F.lit(f"{salt}|"), F.col("bag").cast("string"), F.lit("|"), F.col(key))), F.col(key)]
    return tagged.withColumn("_k", F.row_number().over(Window.partitionBy("bag").orderBy(*order))).where(F.col("_k") <= size).drop("_k")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return sequential_rank(df, order, by, name).where(F.col(name) <= k)


def pareto_front(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rows that no other row of their group beats in one score and equals or beats in the other.

    The best y for each x comes first, so what the window sorts is one row for each distinct x, and x without a best y go.
    """
    keys = by or []
    best = df.groupBy(*keys, x).agg(F.max(y).alias(y))
    beyond = Window.partitionBy(*keys).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("_m", F.max(y).over(beyond)).where(F.col("_m").isNull() | (F.col(y) > F.col("_m"))).drop("_m")
    return df.join(front, [*keys, x, y], "left_semi")


def first_of_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return top_per_group(df, by, order, 1, "_first").drop("_first")


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, spearman): the correlation of average ranks; 0 where it is undefined."""
    ranked = average_rank(average_rank(df, x, by, "_x"), y, by, "_y")
    spread = F.col("_sx") * F.col("_sy")
    sums = ranked.groupBy(*by).agg(F.covar_pop("_x", "_y").alias("_c"), F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy"))
    return sums.select(*by, F.when(spread > 1e-15, F.col("_c") / F.when(spread > 1e-15, spread)).otherwise(0.0).alias("spearman"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of a page, from 1, of the sorted frame."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows whose values, one after another, hold the text in any case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in df.columns))), F.lit(text.lower())))
