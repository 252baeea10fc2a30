import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ranking


def brute_auc(v, y):
    a, b = [x for x, l in zip(v, y) if l], [x for x, l in zip(v, y) if not l]
    return sum((p > q) + (p == q) / 2 for p in a for q in b) / max(1, len(a) * len(b))


@pytest.mark.parametrize("seed", range(3))
def test_auc_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(f, r.randint(0, 6) / 2, int(r.random() < 0.4)) for f in range(5) for _ in range(40)]
    got = {x["feature"]: x["auc"] for x in ranking.auc(spark.createDataFrame(rows, "feature int, value double, label int"), ["feature"]).collect()}
    for f in range(5):
        mine = [(v, y) for g, v, y in rows if g == f]
        assert abs(got[f] - brute_auc(*zip(*mine))) < 1e-12


def test_auc_vectors(spark):
    rows = [("up", 3.0, 1), ("up", 4.0, 1), ("up", 1.0, 0), ("up", 2.0, 0), ("down", 1.0, 1), ("down", 2.0, 1), ("down", 3.0, 0), ("down", 4.0, 0)] + [("tie", 1.0, y) for y in (0, 0, 1, 1)]
    got = {x["feature"]: x["auc"] for x in ranking.auc(spark.createDataFrame(rows, "feature string, value double, label int"), ["feature"]).collect()}
    assert got == {"up": 1.0, "down": 0.0, "tie": 0.5}


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "i int, p_value double")
    assert [round(r["fdr"], 12) for r in ranking.benjamini_hochberg(df).orderBy("i").collect()] == [0.03, 0.04, 0.04]


def test_benjamini_hochberg_of_values_that_differ_when_computed_again(spark):
    """Sums of doubles end in another bit when their parts come in another order."""
    p = F.udf(lambda i: (i + 1 + random.random()) / 40, "double").asNondeterministic()
    rows = ranking.benjamini_hochberg(spark.range(30).withColumn("p_value", p("id"))).collect()
    assert len(rows) == 30 and all(r["fdr"] is not None for r in rows)
    ordered = sorted(r["p_value"] for r in rows)
    for r in rows:
        assert abs(r["fdr"] - min(1.0, *(q * 30 / k for k, q in enumerate(ordered, 1) if q >= r["p_value"]))) < 1e-12


def test_percentile_rank_of_one(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 3)], "g string, v int")
    got = [(r["g"], r["percentile"]) for r in ranking.percentile_rank(df, [F.col("v")], ["g"]).orderBy("g", "v").collect()]
    assert got == [("a", 1.0), ("b", 0.0), ("b", 0.5), ("b", 1.0)]


@pytest.mark.parametrize("seed", range(4))
def test_front_equals_not_exists(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.randint(0, 5), r.randint(0, 5)) for i in range(30)]
    front = {i for i, x, y in rows if not any(a >= x and b >= y and (a > x or b > y) for _, a, b in rows)}
    got = {r["i"] for r in ranking.pareto_front(spark.createDataFrame(rows, "i int, x int, y int"), "x", "y").collect()}
    assert got == front


def test_global_rank(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(1000)]
    got = ranking.global_rank(spark.createDataFrame(rows, "i int, v int").repartition(5), [F.desc("v"), F.col("i")]).collect()
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}
    assert {r["i"]: r["rank"] for r in got} == want


@pytest.mark.parametrize("seed", range(3))
def test_midrank(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("ab"), float(r.randint(0, 4)), 0, i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, fam string, score double, g int, held boolean")
    got = {x["i"]: (x["rank"], x["percentile"]) for x in ranking.held_out_midrank(df.where("held"), df.where("not held"), ["g"], "fam").collect()}
    for i, fam, s, _, held in rows:
        if held:
            pool = [t for _, f, t, _, h in rows if not h and f != fam]
            worse = sum(t > s for t in pool) + sum(t == s for t in pool) / 2
            assert got[i] == (1 + worse, 1 - worse / max(1, len(pool)))


def test_spearman(spark):
    df = spark.createDataFrame([("up", 1, 10), ("up", 2, 20), ("up", 3, 30), ("down", 1, 3), ("down", 2, 2), ("down", 3, 1), ("flat", 1, 1), ("flat", 2, 1)], "g string, x int, y int")
    assert {r["g"]: round(r["spearman"], 12) for r in ranking.spearman(df, "x", "y", ["g"]).collect()} == {"up": 1.0, "down": -1.0, "flat": 0.0}


def test_folds_and_bags(spark):
    df = spark.createDataFrame([(str(i), i % 2) for i in range(50)], "k string, y int")
    sizes = ranking.hash_folds(df, F.col("k"), 5, ["y"]).groupBy("y", "fold").count().collect()
    assert len(sizes) == 10 and all(r["count"] == 5 for r in sizes)
    bags = ranking.hash_bags(df, "k", 3, 10, "s").groupBy("bag").count().collect()
    assert sorted((r["bag"], r["count"]) for r in bags) == [(0, 10), (1, 10), (2, 10)]
    assert ranking.hash_bags(df, "k", 1, 100, "s").count() == 50


def test_average_rank(spark):
    v = [3.0, 1.0, 3.0, 2.0]
    df = spark.createDataFrame([(0, x) for x in v], "g int, v double")
    got = sorted((r["v"], r["average_rank"]) for r in ranking.average_rank(df, "v", ["g"]).collect())
    assert got == sorted(zip(v, pd.Series(v).rank().tolist()))
    assert np.isclose(sum(x for _, x in got), 10)
