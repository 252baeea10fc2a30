"""URL filters by host-suffix and path-prefix expressions.

Each URL becomes a few expressions ``host suffix`` + ``path prefix``. An expression's SHA-256
digest is compared with the rules' digests: an equi-join on the first four bytes finds
candidates, the full digest confirms them, and the longest confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast (about 100 bytes each); more are joined by a salted shuffle.
BROADCAST_RULES = 200_000
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a frame."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Every row's host, path, deciding rule and verdict.

    ``pages``: page_id, url. ``rules``: action (``allow`` or ``block``), host, path. A rule fits
    its host and all subdomains when the path starts with the rule's path. The longest rule
    (host and path together) wins; at equal length the longer host, then ``block``. Without a rule
    the verdict is ``default`` and ``rule`` is null.

    Null or malformed urls have empty host and path and meet no rule, but for a rule of an empty
    host none exists (such rules are ignored, as are rules with a null part). Rows that repeat are
    judged and returned each. Hosts are cut only to the numbers of labels that rules have, paths only to
    the lengths that rules have, so a very long url costs no more expressions than a short one. Empty tables give empty results; further columns are ignored.
    """
    rules = (
        only(rules, "action", "host", "path")
        .where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != "") & F.col("action").isin("allow", "block"))
        .withColumn("host", F.translate("host", UPPER, LOWER))
        .distinct()
    )
    facts = rules.agg(F.count("*"), F.collect_set(F.length("path")), F.collect_set(labels_of("host"))).first()
    n_rules, lengths, depths = facts[0], sorted(facts[1] or []), sorted(facts[2] or [])
    known = rules.select(
        digest_of(F.col("host"), F.col("path")).alias("rule_digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
            (F.col("action") == "block").cast("int").alias("blocks"),
            F.concat("host", "path").alias("rule"), "action",
        ).alias("found"),
    ).withColumn("prefix", F.substring("rule_digest", 1, 8))

    host, path = host_and_path(F.col("url"))
    # repeats of a row are counted first; what follows keeps this partitioning, so it is the one shuffle
    rows = only(pages, "page_id", "url").groupBy("page_id", "url").agg(F.count("*").alias("n"))
    split = rows.withColumn("host", host).withColumn("path", path)
    suffixes = F.array_compact(F.array(*(F.when((F.col("host") != "") & (labels_of("host") >= n), F.substring_index("host", ".", -n)) for n in depths)).cast("array<string>"))
    sizes = F.array(*(F.lit(n) for n in lengths)).cast("array<int>")
    prefixes = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host_part"), p.alias("path_part")))))
    keys = ["page_id", "url", "n", "host", "path"]
    wide = split.select(*keys, F.explode_outer(expressions).alias("e"))
    wide = wide.withColumn("digest", F.when(F.col("e").isNotNull(), digest_of(F.col("e.host_part"), F.col("e.path_part"))))
    wide = wide.withColumn("prefix", F.substring("digest", 1, 8)).drop("e")
    if n_rules <= BROADCAST_RULES:
        met = wide.join(F.broadcast(known), "prefix", "left")
    else:  # a common suffix such as com is a hot key: its rows are dealt over salts, rules are repeated
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = wide.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"], "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("found"))
    best = met.groupBy(*keys).agg(F.max(confirmed).alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_n"),
    ).drop("_n")


def labels_of(host: str) -> Column:
    """Labels of a host: one more than its dots."""
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def digest_of(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path).cast("binary"), 256)
