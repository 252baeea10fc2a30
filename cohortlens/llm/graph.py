"""Connected components over edge tables, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, hot_keys, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the links (a, b): the component is the smallest node reachable.

    Each round every node takes the smallest label of its neighbours, then its label's label; rounds
    go on until none changes, each is written to the shared folder. Nulls link nothing, loops and repeats do no
    harm. A hub's many edges, and the many nodes of one label, meet their one partner over salts; minima are partial.
    """
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = materialize(links.union(links.select("b", "a")).toDF("a", "b").distinct())
    labels = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    hubs = hot_keys(edges, "b")
    while True:
        near = hot_join(edges, labels.toDF("b", "c"), ["b"], F.col("a"), hubs).groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        once = labels.join(near, "node", "left").select("node", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        once = materialize(once)
        jump = once.select(F.col("node").alias("component"), F.col("component").alias("c"))
        twice = hot_join(once, jump, ["component"], F.col("node"), hot_keys(once, "component"), "left").select("node", F.least("component", "c").alias("component"), "was")
        twice = materialize(twice)
        labels = twice.select("node", "component")
        if twice.where("component <> was").isEmpty():
            return labels
