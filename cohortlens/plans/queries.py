"""Registered queries of the library's operators, each over whole tables, and the SQL they must agree with.

Doubles are rounded to six places, counts are 64-bit. ``embeddings`` stands for a log-scale sample x feature matrix
with label 0 as the case class, ``events`` for linear measurements with even users as cases, the A, C, G and U of
whole ``documents`` texts for sequences, and ``labels.quality`` for curated positives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, names, scores, sequence, stats
from ..operators import checks, learning, matching, matrix, ranking, resampling, sequences
from ..storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c, name: str):  # noqa: ANN001, ANN201
    return F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name)


def big(c, name: str):  # noqa: ANN001, ANN201
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


# --- frames the queries start from, with the SQL of the same frames --------------------------------


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(sample, label, feature, value) of the embeddings."""
    e = table(spark, d, "embeddings").where("embedding is not null and label is not null")
    return matrix.explode_vector(e, [F.col("vec_id").alias("sample"), (F.col("label") == 0).cast("int").alias("label")], "embedding")


EMB = """emb AS (SELECT vec_id AS sample, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, generate_subscripts(embedding, 1) - 1 AS feature,
 unnest(embedding)::DOUBLE AS value FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"""
CEN = EMB + """, cen AS (SELECT sample, label, feature, round(value - avg(value) OVER (PARTITION BY sample), 9) AS value FROM emb)"""


def measurements(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("sample"), (F.col("user_id") % 2 == 0).cast("int").alias("label"), F.col("event_type").alias("feature"), "value")


EVT = """evt AS (SELECT event_id AS sample, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS label, event_type AS feature, value FROM events)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """(entity, name, sequence, family, positive) of the documents' whole texts."""
    docs = table(spark, d, "documents").select("doc_id", sequence.normalize_sequence(F.col("text")).alias("sequence"))
    marked = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = docs.join(marked, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("entity"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "sequence",
        sequence.seed(F.col("sequence")).alias("family"), (F.coalesce("quality", F.lit(0)) == 1).cast("int").alias("positive"),
    )


def reused_entries(spark: SparkSession, d: str) -> DataFrame:
    """The same, written once: for queries that read it on several branches, so texts are normalised once."""
    return materialize(entries(spark, d))


SEQ = """seq AS (SELECT d.doc_id AS entity, 'd' || d.doc_id AS name, regexp_replace(translate(upper(coalesce(d.text, '')), 'T', 'U'), '[^ACGU]', '', 'g') AS sequence,
 CASE WHEN coalesce(l.quality, 0) = 1 THEN 1 ELSE 0 END AS positive FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
fam AS (SELECT *, substr(sequence, 2, 7) AS family FROM seq)"""


def references(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("entity"), sequence.normalize_sequence(F.col("text")).alias("sequence"))


REF = """ref AS (SELECT item_id AS entity, regexp_replace(translate(upper(coalesce(text, '')), 'T', 'U'), '[^ACGU]', '', 'g') AS sequence FROM benchmark)"""


def kmer_sql(source: str, sizes: tuple[int, ...]) -> str:
    return " UNION ALL ".join(f"SELECT entity, substr(sequence, i::INT, {k}) AS feature FROM (SELECT entity, sequence, unnest(range(1, greatest(length(sequence) - {k} + 2, 1))) AS i FROM {source})" for k in sizes)


def seeded_sql(source: str, sizes: tuple[int, ...]) -> str:
    """The same with the seed, which counts twice."""
    return f"{kmer_sql(source, sizes)} UNION ALL SELECT entity, 'seed:' || substr(sequence, 2, 7) FROM {source}, range(2)"


AUC_SQL = """(SELECT feature, (sum(CASE WHEN label = 1 THEN ar END) - sum(label) * (sum(label) + 1) / 2.0) / greatest(1.0, sum(label)::DOUBLE * sum(1 - label)) AS auc,
 sum(label)::DOUBLE AS n1, sum(1 - label)::DOUBLE AS n0
 FROM (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS ar FROM {src}) GROUP BY feature)"""

PHI = """(0.5 * (1 + sign({z}) * (1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z}) / 2))))"""


def inference_sql(src: str) -> str:
    """auc, n1, n0 -> with standard_error, ci_low, ci_high, p_value."""
    return f"""(SELECT *, greatest(0.0, auc - 1.96 * standard_error) AS ci_low, least(1.0, auc + 1.96 * standard_error) AS ci_high,
 greatest(1e-16, least(1.0, 1 - {PHI.format(z='z', t='(1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)))')})) AS p_value FROM (
 SELECT *, sqrt(greatest(0.0, (a * (1 - a) + (n1 - 1) * (a / greatest(1e-12, 2 - a) - a * a) + (n0 - 1) * (2 * a * a / greatest(1e-12, 1 + a) - a * a)) / greatest(1.0, n1 * n0))) AS standard_error,
 (auc - 0.5) / sqrt((n1 + n0 + 1) / greatest(1.0, 12 * n1 * n0)) AS z FROM (
 SELECT *, CASE WHEN auc <= 0 OR auc >= 1 THEN (auc * greatest(1.0, n1 * n0) + 0.5) / (greatest(1.0, n1 * n0) + 1) ELSE auc END AS a FROM {src})))"""


def bh_sql(src: str, p: str = "p_value") -> str:
    return f"""(SELECT * EXCLUDE (_k, _n), min(least(1.0, {p} * _n / _k)) OVER (ORDER BY _k DESC ROWS UNBOUNDED PRECEDING) AS fdr
 FROM (SELECT *, row_number() OVER (ORDER BY {p}, feature) AS _k, count(*) OVER () AS _n FROM {src}))"""


FNV = "list_reduce(list_prepend(2166136261::BIGINT, [ord(c)::BIGINT FOR c IN string_split({x}, '') IF c <> '']), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def profile_sql(src: str) -> str:
    return f"""(SELECT feature, sum(label)::DOUBLE AS n1, sum(1 - label)::DOUBLE AS n0, avg(CASE WHEN label = 1 THEN value END) AS m1, avg(CASE WHEN label = 0 THEN value END) AS m0,
 coalesce(stddev_samp(CASE WHEN label = 1 THEN value END), 0) AS s1, coalesce(stddev_samp(CASE WHEN label = 0 THEN value END), 0) AS s0,
 100 * avg(CASE WHEN label = 1 THEN (value > 0)::INT END) AS detect1, 100 * avg(CASE WHEN label = 0 THEN (value > 0)::INT END) AS detect0 FROM {src} GROUP BY feature)"""


# --- association ----------------------------------------------------------------------------------


def centered(spark: SparkSession, d: str) -> DataFrame:
    return matrix.center_by_sample(samples(spark, d)).withColumn("value", F.round("value", 9))


@query(f"""WITH {CEN} SELECT feature::INT AS feature, round(auc, 6) AS auc, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6) AS p_value, round(fdr, 6) AS fdr,
row_number() OVER (ORDER BY auc DESC, feature)::BIGINT AS rank FROM {bh_sql(inference_sql(AUC_SQL.format(src="cen")))}""")
def feature_association(spark: SparkSession, d: str) -> DataFrame:
    """Which features separate cases from controls: the flagship query."""
    tested = ranking.benjamini_hochberg(ranking.auc_inference(ranking.auc(centered(spark, d), ["feature"])))
    ranked = ranking.sequential_rank(tested, [F.desc("auc"), F.col("feature")])
    return ranked.select("feature", *(r6(c, c) for c in ("auc", "ci_low", "ci_high", "p_value", "fdr")), big("rank", "rank"))


@query(f"WITH {EMB} SELECT feature::INT AS feature, round(auc, 6) AS auc, n1::BIGINT AS n1, n0::BIGINT AS n0 FROM {AUC_SQL.format(src='emb')}")
def auc_by_feature(spark: SparkSession, d: str) -> DataFrame:
    return ranking.auc(samples(spark, d), ["feature"]).select("feature", r6("auc", "auc"), big("n1", "n1"), big("n0", "n0"))


@query(f"WITH {CEN} SELECT feature::INT AS feature, round(m1, 6) AS m1, round(m0, 6) AS m0, round(m1 - m0, 6) AS difference FROM {profile_sql('cen')}")
def centered_effects(spark: SparkSession, d: str) -> DataFrame:
    p = matrix.class_profile(centered(spark, d))
    return p.select("feature", r6("m1", "m1"), r6("m0", "m0"), r6(F.col("m1") - F.col("m0"), "difference"))


@query(f"""WITH {EVT} SELECT feature, round(m1 - m0, 6) AS difference, round(se, 6) AS standard_error, round(m1 - m0 - 1.96 * se, 6) AS ci_low, round(m1 - m0 + 1.96 * se, 6) AS ci_high,
round((1 - 3 / greatest(4.0, 4 * (n1 + n0) - 9)) * (m1 - m0) / sqrt(((n1 - 1) * s1 * s1 + (n0 - 1) * s0 * s0) / (n1 + n0 - 2)), 6) AS hedges_g
FROM (SELECT *, sqrt(s1 * s1 / n1 + s0 * s0 / n0) AS se FROM {profile_sql('evt')})""")
def welch_hedges(spark: SparkSession, d: str) -> DataFrame:
    p = matrix.class_profile(measurements(spark, d))
    c = {k: F.col(k) for k in ("n1", "n0", "m1", "m0", "s1", "s0")}
    gap, se = c["m1"] - c["m0"], stats.welch_error(c["s1"], c["n1"], c["s0"], c["n0"])
    g = stats.hedges_g(c["m1"], c["s1"], c["n1"], c["m0"], c["s0"], c["n0"])
    return p.select("feature", r6(gap, "difference"), r6(se, "standard_error"), r6(gap - 1.96 * se, "ci_low"), r6(gap + 1.96 * se, "ci_high"), r6(g, "hedges_g"))


@query(f"""WITH {EVT} SELECT feature, round((m1 - m0) / CASE WHEN s1 > 0 OR s0 > 0 THEN sqrt((s1 * s1 + s0 * s0) / 2) ELSE 1 END, 6) AS cohen_d, round(log2((m1 + 1) / (m0 + 1)), 6) AS log2_fold_change,
round(detect1 - detect0, 6) AS detection_gap, round(2 * auc - 1, 6) AS cliffs_delta FROM {profile_sql('evt')} JOIN {AUC_SQL.format(src='evt')} USING (feature)""")
def effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    long = measurements(spark, d)
    p = matrix.class_profile(long).join(ranking.auc(long, ["feature"]).select("feature", "auc"), "feature")
    return p.select(
        "feature", r6(stats.cohen_d(F.col("m1"), F.col("s1"), F.col("m0"), F.col("s0")), "cohen_d"), r6(stats.log2_fold_change(F.col("m1"), F.col("m0")), "log2_fold_change"),
        r6(F.col("detect1") - F.col("detect0"), "detection_gap"), r6(2 * F.col("auc") - 1, "cliffs_delta"),
    )


@query("""WITH g AS (SELECT o_custkey % 97 AS feature, least(1.0, abs(avg(o_totalprice) - 100000) / 200000) AS p FROM orders GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS k, count(*) OVER () AS n FROM g)
SELECT feature, round(p, 6) AS p, round(min(least(1.0, p * n / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 6) AS fdr FROM k""")
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy((F.col("o_custkey") % 97).alias("feature")).agg(F.least(F.lit(1.0), F.abs(F.avg("o_totalprice") - 100000) / 200000).alias("p"))
    return ranking.benjamini_hochberg(g, "p").select("feature", r6("p", "p"), r6("fdr", "fdr"))


@query(f"""WITH {EMB}, t AS (SELECT *, (feature % 8)::BIGINT AS hypothesis FROM {inference_sql(AUC_SQL.format(src="emb"))}),
h AS (SELECT hypothesis AS feature, min(p_value) AS p_value FROM t GROUP BY 1), f AS (SELECT * FROM {bh_sql("h")})
SELECT t.feature::INT AS feature, hypothesis, round(fdr, 6) AS fdr, count(*) OVER (PARTITION BY hypothesis)::BIGINT AS sharing FROM t JOIN f ON hypothesis = f.feature""")
def distinct_hypothesis_fdr(spark: SparkSession, d: str) -> DataFrame:
    tested = ranking.auc_inference(ranking.auc(samples(spark, d), ["feature"]))
    out = ranking.distinct_fdr(tested, (F.col("feature") % 8).cast("long"))
    return out.select("feature", "hypothesis", r6("fdr", "fdr"), big("sharing", "sharing"))


@query("""WITH r AS (SELECT o_orderpriority AS priority, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderpriority, o_orderdate) - 1) / 2.0 AS y FROM orders)
SELECT priority, round(corr(x, y), 6) AS spearman FROM r GROUP BY priority""")
def spearman_rank(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "priority")
    return ranking.spearman(o, "o_totalprice", "o_orderdate", ["priority"]).select("priority", r6("spearman", "spearman"))


@query("""SELECT p_partkey, round(CASE WHEN n = 1 THEN 1.0 ELSE (k - 1) / (n - 1) END, 6) AS percentile FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k,
count(*) OVER (PARTITION BY p_brand)::DOUBLE AS n FROM part)""")
def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.percentile_rank(table(spark, d, "part"), [F.col("p_retailprice"), F.col("p_partkey")], ["p_brand"]).select("p_partkey", r6("percentile", "percentile"))


@query("""SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS rank FROM customer""")
def global_ranks(spark: SparkSession, d: str) -> DataFrame:
    return ranking.global_rank(table(spark, d, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_custkey", big("rank", "rank"))


@query("""SELECT event_type AS feature, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS deviation, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75,
round(min(value), 6) AS least, round(max(value), 6) AS most, count(*) AS n FROM events GROUP BY 1""")
def quantile_profile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("feature"))
    return e.agg(
        r6(F.median("value"), "median"), r6(stats.std0(F.col("value")), "deviation"), r6(F.percentile("value", 0.25), "q25"), r6(F.percentile("value", 0.75), "q75"),
        r6(F.min("value"), "least"), r6(F.max("value"), "most"), F.count("*").alias("n"),
    )


@query(f"""WITH {EMB} SELECT sum((m1 > m0)::INT)::BIGINT AS higher, sum((m1 < m0)::INT)::BIGINT AS lower, sum((m1 = m0)::INT)::BIGINT AS equal, round(avg((m1 > m0)::INT), 6) AS share_higher,
round(quantile_cont(m1 - m0, 0.05), 6) AS q05, round(quantile_cont(m1 - m0, 0.5), 6) AS q50, round(quantile_cont(m1 - m0, 0.95), 6) AS q95 FROM {profile_sql('emb')}""")
def global_shift(spark: SparkSession, d: str) -> DataFrame:
    out = matrix.global_shift(matrix.class_profile(samples(spark, d)))
    q = [r6(F.element_at("quantiles", i), n) for i, n in ((2, "q05"), (4, "q50"), (6, "q95"))]
    return out.select(big("higher", "higher"), big("lower", "lower"), big("equal", "equal"), r6("share_higher", "share_higher"), *q)


@query(f"""WITH {EMB}, m AS (SELECT sample, label, 0 AS feature, round(avg(value), 9) AS value FROM emb GROUP BY sample, label) SELECT round(auc, 6) AS auc FROM {AUC_SQL.format(src='m')}""")
def sample_mean_auc(spark: SparkSession, d: str) -> DataFrame:
    means = samples(spark, d).groupBy("sample", "label").agg(F.round(F.avg("value"), 9).alias("value")).withColumn("feature", F.lit(0))
    return ranking.auc(means, ["feature"]).select(r6("auc", "auc"))


@query("""WITH s AS (SELECT l.quality AS label, (d.n_chars > 1500)::INT AS predicted FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT sum((label = 1 AND predicted = 1)::INT)::BIGINT AS tp, sum((label = 0 AND predicted = 0)::INT)::BIGINT AS tn, sum((label = 0 AND predicted = 1)::INT)::BIGINT AS fp, sum((label = 1 AND predicted = 0)::INT)::BIGINT AS fn FROM s)
SELECT tp, tn, fp, fn, round((tp + tn) / greatest(1, tp + tn + fp + fn), 6) AS accuracy, round(tp / greatest(1, tp + fp), 6) AS "precision", round(tp / greatest(1, tp + fn), 6) AS recall,
round(tn / greatest(1, tn + fp), 6) AS specificity, round(2 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1 FROM c""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1500).alias("hit")), "doc_id")
    y, hit = F.col("quality"), F.col("hit")
    c = s.agg(F.count_if((y == 1) & hit).alias("tp"), F.count_if((y == 0) & ~hit).alias("tn"), F.count_if((y == 0) & hit).alias("fp"), F.count_if((y == 1) & ~hit).alias("fn"))
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    one = F.lit(1)
    return c.select(
        "tp", "tn", "fp", "fn", r6((tp + tn) / F.greatest(one, tp + tn + fp + fn), "accuracy"), r6(tp / F.greatest(one, tp + fp), "precision"),
        r6(tp / F.greatest(one, tp + fn), "recall"), r6(tn / F.greatest(one, tn + fp), "specificity"), r6(stats.f1_counts(tp, fp, fn), "f1"),
    )


@query(f"""WITH {EMB} SELECT feature::INT AS feature, round(0.6 * greatest(0.0, (greatest(auc, 1 - auc) - 0.5) * 2) + 0.3 * least(1.0, abs(m1 - m0) / 3) + 0.1 * least(1.0, abs(detect1 - detect0) / 50), 6) AS expression_score,
round(0.7 * greatest(0.0, (auc - 0.5) * 2) + 0.2 * least(1.0, abs(m1 - m0) / 3) + 0.1 * least(1.0, abs(detect1 - detect0) / 50), 6) AS validation_score,
round(0.45 * auc + 0.45 * least(1.0, abs(m1 - m0)) + 0.1 * abs(2 * auc - 1), 6) AS integrated, CASE WHEN m1 - m0 > 0.05 THEN 'higher' WHEN m1 - m0 < -0.05 THEN 'lower' ELSE 'none' END AS direction
FROM {profile_sql('emb')} JOIN (SELECT feature, auc FROM {AUC_SQL.format(src='emb')}) USING (feature)""")
def evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    long = samples(spark, d)
    p = matrix.class_profile(long).join(ranking.auc(long, ["feature"]).select("feature", "auc"), "feature")
    a, fc, gap = F.col("auc"), stats.log2_fold_change(F.col("m1"), F.col("m0"), log_scale=True), F.col("detect1") - F.col("detect0")
    return p.select(
        "feature", r6(scores.expression_score(a, fc, gap), "expression_score"), r6(scores.validation_score(a, fc, gap), "validation_score"),
        r6(scores.blend((0.45, a), (0.45, F.least(F.lit(1.0), F.abs(fc))), (0.1, F.abs(2 * a - 1))), "integrated"), scores.direction_from_fold_change(fc).alias("direction"),
    )


VERDICT = f"""v AS (SELECT feature, src, CASE WHEN lower THEN 1 - auc ELSE auc END AS directed, CASE WHEN lower THEN 1 - ci_high ELSE ci_low END AS low, fdr, n1, n0 FROM (
SELECT *, feature % 3 = 0 AS lower, 'plain' AS src FROM {bh_sql(inference_sql(AUC_SQL.format(src="emb")))} UNION ALL SELECT *, feature % 3 = 0, 'centred' FROM {bh_sql(inference_sql(AUC_SQL.format(src="cen")))}))"""


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    def of(long: DataFrame, source: str) -> DataFrame:
        return ranking.benjamini_hochberg(ranking.auc_inference(ranking.auc(long, ["feature"]))).withColumn("src", F.lit(source))

    both = of(samples(spark, d), "plain").unionByName(of(centered(spark, d), "centred"))
    lower = F.when(F.col("feature") % 3 == 0, "lower")
    directed = scores.directional(F.col("auc"), lower, flip_from=1.0)
    low = F.when(lower == "lower", 1 - F.col("ci_high")).otherwise(F.col("ci_low"))
    out = both.withColumn("directed", directed).withColumn("low", low)
    return out.withColumn("ok", scores.replicated(F.col("n1"), F.col("n0"), F.col("directed") > 0.5, F.col("low"), F.col("fdr")))


OK = "(n1 >= 10 AND n0 >= 10 AND directed > 0.5 AND low > 0.5 AND fdr < 0.05)"


@query(f"WITH {CEN}, {VERDICT} SELECT feature::INT AS feature, src, round(directed, 6) AS directed, {OK}::INT AS replicated, ({OK} AND directed >= 0.6)::INT AS practical FROM v")
def replication_verdict(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts(spark, d)
    return v.select("feature", "src", r6("directed", "directed"), F.col("ok").cast("int").alias("replicated"), (F.col("ok") & (F.col("directed") >= 0.6)).cast("int").alias("practical"))


@query(f"WITH {CEN}, {VERDICT} SELECT feature::INT AS feature FROM v WHERE src = 'plain' AND directed > 0.51 INTERSECT SELECT feature::INT FROM v WHERE src = 'centred' AND directed > 0.51")
def robust_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Features on the expected side in both analyses; none of this noise is replicated outright."""
    v = verdicts(spark, d).where("directed > 0.51")
    return v.where("src = 'plain'").select("feature").intersect(v.where("src = 'centred'").select("feature"))


@query(f"""WITH {CEN}, {VERDICT}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY directed DESC, feature) AS rank FROM v)
SELECT src, cut, count(*) AS found, sum({OK}::INT)::BIGINT AS replicated FROM k JOIN (VALUES (10), (20), (50)) t(cut) ON rank <= cut GROUP BY src, cut""")
def topk_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    v = ranking.sequential_rank(verdicts(spark, d), [F.desc("directed"), F.col("feature")], ["src"])
    cut = v.withColumn("cut", F.explode(F.array(*map(F.lit, (10, 20, 50))))).where("rank <= cut")
    return cut.groupBy("src", "cut").agg(F.count("*").alias("found"), F.count_if("ok").alias("replicated"))


# --- ranking, windows, sets ------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_quantity, l_discount, count(*) AS n FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_returnflag AS f, l_quantity AS q, l_discount AS c FROM lineitem) b
WHERE f = a.l_returnflag AND q >= a.l_quantity AND c >= a.l_discount AND (q > a.l_quantity OR c > a.l_discount)) GROUP BY ALL""")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    front = ranking.pareto_front(table(spark, d, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"])
    return front.groupBy("l_returnflag", "l_quantity", "l_discount").agg(F.count("*").alias("n"))


@query(f"""SELECT event_id, (row_number() OVER (PARTITION BY user_id % 2 ORDER BY {FNV.format(x="'fold|' || event_id")}, event_id::VARCHAR) - 1) % 5 AS fold FROM events""")
def hash_folds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("class", F.col("user_id") % 2)
    return ranking.hash_folds(e, F.col("event_id").cast("string"), 5, ["class"], "fold|").select("event_id", big("fold", "fold"))


@query(f"""WITH {SEQ}, b AS (SELECT name, bag, row_number() OVER (PARTITION BY bag ORDER BY {FNV.format(x="'salt|' || bag || '|' || name")}, name) AS k FROM fam, range(3) t(bag))
SELECT bag, name FROM b WHERE k <= 100""")
def deterministic_bag(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hash_bags(entries(spark, d).select("name"), "name", 3, 100, "salt").select(big("bag", "bag"), "name")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS sharing FROM lineitem""")
def ambiguity_count(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", big("l_linenumber", "l_linenumber"), F.count("*").over(w).alias("sharing"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_of_key(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations)
WHERE k <> turn OR length(text) > q + 1e-12""")
def rank_contiguity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return checks.rank_violations(c, "turn", "size", ["conv_id"]).select("conv_id", "turn")


@query(f"""WITH {SEQ}, s AS (SELECT entity, family, positive, round(length(regexp_replace(sequence, '[^GC]', '', 'g')) / greatest(1, length(sequence)), 6) AS score FROM fam)
SELECT h.entity, 1 + coalesce(sum((b.score > h.score)::INT), 0) + coalesce(sum((b.score = h.score)::INT), 0) / 2 AS rank,
round(1 - (coalesce(sum((b.score > h.score)::INT), 0) + coalesce(sum((b.score = h.score)::INT), 0) / 2) / greatest(1, count(b.entity)), 6) AS percentile
FROM (SELECT * FROM s WHERE positive = 1) h LEFT JOIN (SELECT * FROM s WHERE positive = 0) b ON b.family <> h.family GROUP BY h.entity, h.score""")
def heldout_midrank(spark: SparkSession, d: str) -> DataFrame:
    return _midranked(spark, d).select("entity", "rank", r6("percentile", "percentile"))


def _midranked(spark: SparkSession, d: str) -> DataFrame:
    s = reused_entries(spark, d).withColumn("score", F.round(sequence.gc_fraction(F.col("sequence")), 6)).select("entity", "family", "positive", "score").withColumn("pool_", F.lit(0))
    return ranking.held_out_midrank(s.where("positive = 1"), s.where("positive = 0"), ["pool_"], "family")


MID = f"""mid AS ({SQL['heldout_midrank'][len('WITH '):].split('SELECT h.entity', 1)[0] and 'SELECT h.entity, h.family, ' + SQL['heldout_midrank'].split('SELECT h.entity, ', 1)[1].replace('GROUP BY h.entity, h.score', 'GROUP BY h.entity, h.family, h.score')})"""
MID = MID.replace('round(1 - (', '(1 - (').replace('count(b.entity)), 6) AS', 'count(b.entity))) AS')
MIDS = SQL["heldout_midrank"].split("SELECT h.entity", 1)[0].rstrip() + ", " + MID


@query(MIDS + """ SELECT count(*) AS n, round(avg(percentile), 6) AS mean_percentile, sum((percentile >= 0.99)::INT)::BIGINT AS recovered_1, sum((percentile >= 0.95)::INT)::BIGINT AS recovered_5,
sum((percentile >= 0.9)::INT)::BIGINT AS recovered_10, sum((percentile >= 0.8)::INT)::BIGINT AS recovered_20 FROM mid""")
def recall_at_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    m = _midranked(spark, d)
    out = ranking.recall_at(m.withColumn("all", F.lit(0)), ["all"])
    return out.select("n", r6("mean_percentile", "mean_percentile"), *(f"recovered_{c}" for c in (1, 5, 10, 20)))


@query(MIDS + """ SELECT family, count(*) AS markers, round(avg(percentile), 6) AS percentile, round(max(percentile), 6) AS best FROM mid GROUP BY family""")
def family_two_level(spark: SparkSession, d: str) -> DataFrame:
    m = _midranked(spark, d)
    return m.groupBy("family").agg(F.count("*").alias("markers"), r6(F.avg("percentile"), "percentile"), r6(F.max("percentile"), "best"))


@query("""SELECT p_brand, p_partkey, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::BIGINT AS k FROM part) WHERE k <= 3""")
def top_per_brand(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_per_group(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", big("rank", "rank"))


@query("""SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) INTERSECT SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT max(event_type) FROM events)""")
def intersect_replicated(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    of = lambda c: e.join(F.broadcast(ends), F.col("event_type") == F.col(c)).select("user_id")
    return of("lo").intersect(of("hi"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("""SELECT doc_id, 'case' AS grp FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'control' FROM labels WHERE quality = 0""")
def union_cases_controls(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    return lab.where("quality = 1").select("doc_id", F.lit("case").alias("grp")).unionByName(lab.where("quality = 0").select("doc_id", F.lit("control").alias("grp")))


@query("""SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20""")
def second_page(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page(table(spark, d, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], 2, 20).select("c_custkey", "c_name")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(concat_ws(' ', s_suppkey::VARCHAR, s_name)), '00003')""")
def search_rows(spark: SparkSession, d: str) -> DataFrame:
    return ranking.search_rows(table(spark, d, "supplier").select("s_suppkey", "s_name"), "00003")


# --- joins -------------------------------------------------------------------------------------------


@query("""SELECT l_suppkey AS sample, p_type AS feature, round(sum(l_quantity), 6) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def transpose_aggregate(spark: SparkSession, d: str) -> DataFrame:
    mapping = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("feature"))
    out = matrix.transpose_sum(table(spark, d, "lineitem"), mapping, "l_partkey", "l_suppkey", "l_quantity")
    return out.select(F.col("l_suppkey").alias("sample"), "feature", r6("value", "value"))


@query("""WITH r AS (SELECT DISTINCT p_brand AS k FROM part UNION SELECT DISTINCT left(p_brand, length(p_brand) - 1) FROM part)
SELECT k, count(DISTINCT p_partkey) AS parts FROM r JOIN part ON k = p_brand OR k = left(p_brand, length(p_brand) - 1) GROUP BY k""")
def multi_key_match(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    short = F.expr("left(p_brand, length(p_brand) - 1)")
    rows = part.select(F.col("p_brand").alias("k")).union(part.select(short)).distinct()
    return matching.match_either(rows, part, "k", [F.col("p_brand"), short]).groupBy("k").agg(F.count("*").alias("parts"))


@query("""WITH a AS (SELECT c_custkey AS k, count(*) AS a FROM customer GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS b FROM orders GROUP BY 1)
SELECT CASE WHEN a > 1 THEN 'duplicate on the left' WHEN b > 1 THEN 'duplicate on the right' WHEN b IS NULL THEN 'missing on the right' WHEN a IS NULL THEN 'unused on the right' END AS problem, count(*) AS n
FROM a FULL JOIN b USING (k) WHERE problem IS NOT NULL GROUP BY 1""")
def checked_join_violations(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return matching.one_to_one(c, o, "k")[1].groupBy("problem").agg(F.count("*").alias("n"))


NAMED = """l AS (SELECT o_orderkey, 'hsa-mir-' || (o_custkey % 60) || CASE o_custkey % 3 WHEN 0 THEN '-5p' WHEN 1 THEN '-3p' ELSE '' END AS name, 'hsa-mir-' || (o_custkey % 60) AS family FROM orders),
e AS (SELECT s_suppkey AS id, 'hsa-mir-' || (s_suppkey % 40) || CASE s_suppkey % 2 WHEN 0 THEN '-5p' ELSE '-3p' END AS name, 'hsa-mir-' || (s_suppkey % 40) AS family, s_suppkey % 2 AS pref FROM supplier)"""


def named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, s = table(spark, d, "orders"), table(spark, d, "supplier")
    arm = F.when(F.col("o_custkey") % 3 == 0, "-5p").when(F.col("o_custkey") % 3 == 1, "-3p").otherwise("")
    left = o.select("o_orderkey", F.concat(F.lit("hsa-mir-"), (F.col("o_custkey") % 60).cast("string"), arm).alias("name")).withColumn("family", names.mature_family(F.col("name")))
    tail = F.when(F.col("s_suppkey") % 2 == 0, "-5p").otherwise("-3p")
    right = s.select((F.col("s_suppkey") % 2).alias("pref"), F.concat(F.lit("hsa-mir-"), (F.col("s_suppkey") % 40).cast("string"), tail).alias("name")).distinct()
    return left, right.withColumn("family", names.mature_family(F.col("name"))).withColumn("column", F.col("name"))


@query(f"""WITH {NAMED}, x AS (SELECT DISTINCT name FROM e), f AS (SELECT family, arg_min(name, pref) AS best FROM e GROUP BY family)
SELECT o_orderkey, coalesce(x.name, f.best) AS resolved, CASE WHEN x.name IS NOT NULL THEN 'exact' WHEN f.best IS NOT NULL THEN 'family' ELSE 'absent' END AS method
FROM l LEFT JOIN x ON l.name = x.name LEFT JOIN f ON l.family = f.family""")
def exact_or_family_join(spark: SparkSession, d: str) -> DataFrame:
    left, right = named(spark, d)
    return matching.exact_or_family(left, right, "name", "family", F.col("pref"), "column").select("o_orderkey", "resolved", "method")


@query(f"""WITH {NAMED}, x AS (SELECT DISTINCT name FROM e), f AS (SELECT family, string_agg(DISTINCT name, ';' ORDER BY name) AS wide FROM e GROUP BY family)
SELECT o_orderkey, coalesce(x.name, f.wide, '') AS columns, CASE WHEN x.name IS NOT NULL THEN 'exact' WHEN f.wide IS NOT NULL THEN 'family' ELSE 'absent' END AS method
FROM l LEFT JOIN x ON l.name = x.name LEFT JOIN f ON l.family = f.family""")
def exact_or_all_family_join(spark: SparkSession, d: str) -> DataFrame:
    left, right = named(spark, d)
    out = matching.exact_or_all_family(left, right, "name", "family")
    return out.select("o_orderkey", F.array_join("columns", ";").alias("columns"), "method")


@query("""SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def left_default(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return matching.with_default(table(spark, d, "customer").select("c_custkey"), n, ["c_custkey"], {"orders": 0}).select("c_custkey", big("orders", "orders"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_known(spark: SparkSession, d: str) -> DataFrame:
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(pending, "c_custkey", "left_anti")


@query("SELECT DISTINCT lower(trim(doc_id::VARCHAR)) AS id FROM documents WHERE doc_id::VARCHAR IN (SELECT lower(trim(item_id::VARCHAR)) FROM benchmark)")
def disjoint_ids(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return matching.disjoint_violations(a, b, "id")


@query("""SELECT item, count(*) AS n FROM (SELECT trim(unnest(string_split(regexp_extract(url, '^[^/]*//([^/?#]*)', 1), '.'))) AS item FROM pages) WHERE item <> '' GROUP BY item""")
def split_marker_list(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "pages").select(F.regexp_extract("url", "^[^/]*//([^/?#]*)", 1).alias("hosts"))
    return matching.explode_list(hosts, "hosts", r"\.").groupBy("item").agg(F.count("*").alias("n"))


# --- matrices ----------------------------------------------------------------------------------------


@query(f"WITH {EMB} SELECT sample, 'e' || (feature % 8) AS entity, round(sum(value) / count(*), 6) AS value FROM emb GROUP BY 1, 2")
def row_mean_sources(spark: SparkSession, d: str) -> DataFrame:
    long = samples(spark, d)
    mapping = long.select("feature").distinct().select("feature", F.concat(F.lit("e"), (F.col("feature") % 8).cast("string")).alias("entity"))
    return matrix.row_mean(long, mapping).select("sample", "entity", r6("value", "value"))


@query(f"""WITH {EMB}, f AS (SELECT feature, avg(value) AS m, coalesce(nullif(stddev_samp(value), 0), 1) AS s FROM emb WHERE sample % 5 <> 0 GROUP BY feature)
SELECT feature::INT AS feature, round(avg((value - m) / s), 6) AS mean_z, round(max((value - m) / s), 6) AS top_z FROM emb JOIN f USING (feature) WHERE sample % 5 = 0 GROUP BY feature""")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    z = matrix.standardize(samples(spark, d), F.col("sample") % 5 != 0).where("sample % 5 = 0")
    return z.groupBy("feature").agg(r6(F.avg("z"), "mean_z"), r6(F.max("z"), "top_z"))


@query("SELECT event_type AS feature, round(avg(ln(1 + greatest(0, value))), 6) AS mean_log FROM events GROUP BY 1")
def log1p_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("feature")).agg(r6(F.avg(stats.log1p_scale(F.col("value"))), "mean_log"))


SCORE = {"features": ["l_quantity", "l_extendedprice", "l_tax"], "means": [3.0, 10.0, 0.05], "stds": [0.8, 1.0, 0.02], "weights": [0.7, -0.4, 0.3], "bias": 0.1, "threshold": 0.5}


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(p, 6) AS probability, (p >= 0.5)::INT AS predicted FROM (SELECT *, 1 / (1 + exp(-z)) AS p FROM (SELECT *,
0.1 + 0.7 * (ln(1 + l_quantity) - 3) / 0.8 - 0.4 * (ln(1 + l_extendedprice) - 10) + 0.3 * (ln(1 + l_tax) - 0.05) / 0.02 AS z FROM lineitem))""")
def score_model(spark: SparkSession, d: str) -> DataFrame:
    out = learning.score(table(spark, d, "lineitem"), SCORE)
    return out.select("l_orderkey", big("l_linenumber", "l_linenumber"), "probability", "predicted")


# --- sequences -----------------------------------------------------------------------------------------


@query(f"""WITH {SEQ}, k AS (SELECT DISTINCT entity, feature FROM ({kmer_sql('fam', (2, 3))})) SELECT feature, count(*) AS entities, sum(positive)::BIGINT AS positives FROM k JOIN fam USING (entity) GROUP BY feature""")
def kmer_presence(spark: SparkSession, d: str) -> DataFrame:
    k = sequences.kmer_counts(entries(spark, d), [2, 3], keep=["positive"])
    return k.groupBy("feature").agg(F.count("*").alias("entities"), F.sum("positive").alias("positives"))


@query(f"""WITH {SEQ} SELECT entity, length(sequence)::BIGINT AS size, round(length(regexp_replace(sequence, '[^GC]', '', 'g')) / greatest(1, length(sequence)), 6) AS gc FROM fam""")
def gc_length(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("entity", big(F.length("sequence"), "size"), r6(sequence.gc_fraction(F.col("sequence")), "gc"))


def _share(b: str) -> str:
    return f"(length(regexp_replace(sequence, '[^{b}]', '', 'g')) / greatest(1, length(sequence)))"


@query(f"""WITH {SEQ}, p AS (SELECT entity, {_share('A')} AS a, {_share('C')} AS c, {_share('G')} AS g, {_share('U')} AS u FROM fam)
SELECT entity, round(a, 6) AS a, round(c, 6) AS c, round(g, 6) AS g, round(u, 6) AS u, round(abs({' + '.join(f'CASE WHEN {x} > 0 THEN {x} * log2({x}) ELSE 0 END' for x in 'acgu')}) / 2, 6) AS entropy FROM p""")
def nucleotide_composition(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("sequence")
    return entries(spark, d).select("entity", *(r6(sequence.base_fraction(x, b), b.lower()) for b in "ACGU"), r6(F.abs(sequence.entropy(x)), "entropy"))


@query(f"""WITH {SEQ}, k AS (SELECT substr(sequence, i::INT, 3) AS kmer, (i - 1 + 1.5) / length(sequence) AS c FROM (SELECT sequence, unnest(range(1, greatest(length(sequence) - 1, 1))) AS i FROM fam))
SELECT 'positional:' || CASE WHEN c < 1.0 / 3 THEN '5p' WHEN c < 2.0 / 3 THEN 'center' ELSE '3p' END || ':' || kmer AS feature, count(*) AS n FROM k GROUP BY 1""")
def positional_kmers(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select(F.explode(sequence.positional_kmers(F.col("sequence"), [3])).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


@query(f"""WITH {SEQ} SELECT feature, count(*) AS n FROM (SELECT 'terminal:5p:3:' || left(sequence, 3) AS feature FROM fam WHERE length(sequence) >= 3 UNION ALL SELECT 'terminal:3p:3:' || right(sequence, 3) FROM fam WHERE length(sequence) >= 3) GROUP BY 1""")
def terminal_motifs(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select(F.explode(sequence.terminal_motifs(F.col("sequence"), (3,))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


BAL = """bal AS (SELECT *, b * sum(e) OVER () / greatest(1e-12, sum(b) OVER ()) AS weight FROM (SELECT *, e / count(*) OVER (PARTITION BY family) AS b FROM (SELECT *, (1 + entity % 3)::DOUBLE AS e FROM fam WHERE positive = 1)))"""


def balanced(e: DataFrame) -> DataFrame:
    return sequences.balanced_weights(e.where("positive = 1"), 1 + F.col("entity") % 3)


@query(f"WITH {SEQ}, {BAL} SELECT entity, family, round(weight, 6) AS weight FROM bal")
def family_balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    return balanced(reused_entries(spark, d)).select("entity", "family", r6("weight", "weight"))


VEC = f"vec AS (SELECT entity, feature, count(*) / sum(count(*)) OVER (PARTITION BY entity) AS value FROM ({kmer_sql('fam', (2, 3))}) GROUP BY entity, feature)"


@query(f"""WITH {SEQ}, {BAL}, {VEC}, cen AS (SELECT feature, sum(value * weight) / (SELECT greatest(1.0, sum(weight)) FROM bal) AS c FROM vec JOIN bal USING (entity) GROUP BY feature)
SELECT entity, round(sum(value * coalesce(c, 0)) / (sqrt(sum(value * value)) * (SELECT sqrt(sum(c * c)) FROM cen)), 6) AS cosine FROM vec LEFT JOIN cen USING (feature) GROUP BY entity""")
def centroid_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = reused_entries(spark, d)
    vectors = materialize(sequences.kmer_vectors(e, [2, 3]))
    target = sequences.centroid(vectors, balanced(e))
    return sequences.cosine_to(vectors, target).select("entity", r6("cosine", "cosine"))


@query(f"""WITH {SEQ}, {REF}, a AS (SELECT entity, feature, count(*) AS n FROM ({seeded_sql('fam', (3,))}) GROUP BY ALL), b AS (SELECT entity, feature, count(*) AS n FROM ({seeded_sql('ref', (3,))}) GROUP BY ALL),
na AS (SELECT entity, sqrt(sum(n * n)) AS s FROM a GROUP BY 1), nb AS (SELECT entity, sqrt(sum(n * n)) AS s FROM b GROUP BY 1),
c AS (SELECT a.entity, b.entity AS reference, sum(a.n * b.n) / any_value(na.s * nb.s) AS cosine FROM a JOIN b USING (feature) JOIN na ON na.entity = a.entity JOIN nb ON nb.entity = b.entity GROUP BY 1, 2)
SELECT entity, reference, round(cosine, 6) AS cosine, k::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(cosine, 9) DESC, reference) AS k FROM c) WHERE k <= 3""")
def nearest_references(spark: SparkSession, d: str) -> DataFrame:
    top = sequences.nearest_sequences(entries(spark, d), references(spark, d), [3], 3)
    return top.select(F.col("a").alias("entity"), F.col("b").alias("reference"), r6("cosine", "cosine"), big("rank", "rank"))


@query(f"""WITH {SEQ}, {REF}, s AS (SELECT DISTINCT family FROM fam), m AS (SELECT DISTINCT substr(sequence, 2, 7) AS seed FROM ref)
SELECT entity, round(best, 6) AS best FROM fam JOIN (SELECT family, max(list_sum([(substr(family, i::INT, 1) = substr(seed, i::INT, 1) AND substr(family, i::INT, 1) <> '')::INT FOR i IN range(1, 8)]) / greatest(length(family), length(seed), 1)) AS best FROM s, m GROUP BY family) USING (family)""")
def seed_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = reused_entries(spark, d)
    seeds = references(spark, d).select(sequence.seed(F.col("sequence")).alias("seed")).distinct()
    packed = seeds.agg(F.collect_set("seed").alias("seeds"))  # one row: the curated reference set
    best = F.array_max(F.transform("seeds", lambda s: sequence.position_matches(F.col("family"), s)))
    scored = e.select("family").distinct().join(F.broadcast(packed)).select("family", best.alias("best"))
    return e.join(scored, "family").select("entity", r6("best", "best"))


MOTIF = f"""pk AS (SELECT DISTINCT entity, feature FROM ({kmer_sql('fam', (3, 4))})), pp AS (SELECT feature AS motif, sum(weight) AS presence FROM pk JOIN bal USING (entity) GROUP BY 1),
bg AS (SELECT feature AS motif, count(*) AS b FROM pk JOIN fam USING (entity) WHERE positive = 0 GROUP BY 1),
mot AS (SELECT motif, presence, round(log2(((presence + 0.5) / ((SELECT sum(weight) FROM bal) + 1)) / ((coalesce(b, 0) + 0.5) / ((SELECT count(DISTINCT entity) FROM pk JOIN fam USING (entity) WHERE positive = 0) + 1))), 9) AS enrichment
FROM pp LEFT JOIN bg USING (motif) WHERE presence >= 2),
top AS (SELECT * FROM mot WHERE enrichment > 0 ORDER BY enrichment DESC, round(presence, 6) DESC, motif LIMIT 30)"""


def motifs(e: DataFrame) -> DataFrame:
    k = sequences.kmer_counts(e, [3, 4])
    background = k.join(e.where("positive = 0").select("entity"), "entity", "left_semi")
    found = sequences.motif_enrichment(k, background, balanced(e), top=None)
    return found.select("motif", "presence", F.round("enrichment", 9).alias("enrichment")).orderBy(F.desc("enrichment"), F.desc(F.round("presence", 6)), "motif").limit(30)


@query(f"WITH {SEQ}, {BAL}, {MOTIF} SELECT motif, round(presence, 6) AS presence, round(enrichment, 6) AS enrichment FROM top")
def motif_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return motifs(reused_entries(spark, d)).select("motif", r6("presence", "presence"), r6("enrichment", "enrichment"))


@query(f"""WITH {SEQ}, {BAL}, {MOTIF} SELECT fam.entity, round(coalesce(sum(top.enrichment), 0) / (SELECT sum(enrichment) FROM top), 6) AS coverage FROM fam LEFT JOIN top ON contains(sequence, motif) GROUP BY fam.entity""")
def motif_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = reused_entries(spark, d)
    return sequences.motif_coverage(e, motifs(e), [3, 4]).select("entity", r6("coverage", "coverage"))


@query("""WITH n AS (SELECT p_partkey, ' HSA-miR-' || (p_partkey % 300) || CASE p_partkey % 4 WHEN 0 THEN '-5p' WHEN 1 THEN '-2-3p' WHEN 2 THEN '-1' ELSE '' END || ' ' AS raw FROM part),
m AS (SELECT *, lower(trim(raw)) AS marker FROM n), b AS (SELECT *, regexp_replace(regexp_replace(marker, '-[35]p$', ''), '-\\d+p$', '') AS base FROM m)
SELECT p_partkey, marker, base, coalesce(nullif(regexp_extract(base, '^(hsa-(?:mir|let)-.+)-\\d+$', 1), ''), base) AS family, regexp_replace(base, '-\\d+$', '') AS legacy, regexp_replace(marker, '^hsa-', '') AS display FROM b""")
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    arm = F.when(F.col("p_partkey") % 4 == 0, "-5p").when(F.col("p_partkey") % 4 == 1, "-2-3p").when(F.col("p_partkey") % 4 == 2, "-1").otherwise("")
    raw = F.concat(F.lit(" HSA-miR-"), (F.col("p_partkey") % 300).cast("string"), arm, F.lit(" "))
    marker = names.marker_name(raw)
    base = names.mature_base(marker)
    return table(spark, d, "part").select(
        "p_partkey", marker.alias("marker"), base.alias("base"), names.precursor_family(base).alias("family"), names.precursor_base_legacy(base).alias("legacy"), names.display_name(raw).alias("display")
    )


# --- hashes and resampling -------------------------------------------------------------------------------

MUL = "(({a} * (({b}) & 65535) + ((({a}) * (({b}) >> 16)) & 65535) * 65536) & 4294967295)"


def uniform_sql(seed: int, i: str) -> str:
    """A SELECT-able scalar subquery of the counter-based draw."""
    s = f"(({seed} + ({i} + 1) * 1831565813) & 4294967295)"
    v = MUL.format(a="xor(s, s >> 15)", b="(s | 1)")
    w = "xor(v, (v + " + MUL.format(a="xor(v, v >> 7)", b="(v | 61)") + ") & 4294967295)"
    return f"(SELECT xor(w, w >> 14) / 4294967296.0 FROM (SELECT {w} AS w FROM (SELECT {v} AS v FROM (SELECT {s} AS s))))"


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round({uniform_sql(0x54C043, '(l_orderkey * 8 + l_linenumber)::BIGINT')}, 9) AS u FROM lineitem")
def counter_uniforms(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", big("l_linenumber", "l_linenumber"), F.round(hashing.counter_uniform(0x54C043, i), 9).alias("u"))


@query(f"SELECT c_custkey, {FNV.format(x='c_name')} AS h FROM customer")
def stable_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", hashing.fnv1a(F.col("c_name")).alias("h"))


AUCS = f"a AS (SELECT feature, round(auc, 9) AS v FROM {AUC_SQL.format(src='emb')}), q AS (SELECT list(v ORDER BY feature) AS vs, count(*)::BIGINT AS n FROM a)"


@query(f"""WITH {EMB}, {AUCS}, i AS (SELECT it, j, n, vs[1 + floor({uniform_sql(0x54C043, '(it * n + j)')} * n)::BIGINT] AS x FROM q, range(4000) t(it), range(1000) s(j) WHERE j < n),
m AS (SELECT it, avg(x) AS m, avg((x >= 0.9)::INT) AS r FROM i GROUP BY it)
SELECT round(quantile_cont(m, 0.025), 6) AS mean_low, round(quantile_cont(m, 0.975), 6) AS mean_high, round(quantile_cont(r, 0.025), 6) AS recall_low, round(quantile_cont(r, 0.975), 6) AS recall_high FROM m""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    a = ranking.auc(samples(spark, d), ["feature"]).select("feature", F.round("auc", 9).alias("v"))
    out = resampling.bootstrap_interval(a, "feature", "v")
    return out.select(*(r6(c, c) for c in out.columns))


@query(f"""WITH {CEN}, a AS (SELECT feature, round(x.auc - y.auc, 9) AS v FROM {AUC_SQL.format(src='cen')} x JOIN {AUC_SQL.format(src='emb')} y USING (feature)), q AS (SELECT list(v ORDER BY feature) AS vs, count(*)::BIGINT AS n, avg(v) AS o FROM a),
i AS (SELECT it, o, avg(CASE WHEN {uniform_sql(12345, '(it * n + j)')} < 0.5 THEN vs[1 + j] ELSE -vs[1 + j] END) AS m FROM q, range(10000) t(it), range(1000) s(j) WHERE j < n GROUP BY it, o)
SELECT round((SELECT o FROM q), 6) AS mean_delta, sum((round(abs(m), 12) >= round(abs(o), 12))::INT)::BIGINT AS hits, (SELECT sum((v > 1e-12)::INT) FROM a)::BIGINT AS improved, (SELECT sum((v < -1e-12)::INT) FROM a)::BIGINT AS worsened FROM i""")
def sign_flip_p(spark: SparkSession, d: str) -> DataFrame:
    a = ranking.auc(centered(spark, d), ["feature"]).join(ranking.auc(samples(spark, d), ["feature"]).select("feature", F.col("auc").alias("b")), "feature")
    out = resampling.paired_comparison(a.select("feature", F.round(F.col("auc") - F.col("b"), 9).alias("v")), "feature", "v", 1, 12345)
    return out.select(r6("mean_delta", "mean_delta"), big(F.round(F.col("p_value") * 10_001 - 1), "hits"), "improved", "worsened")


@query(None)
def random_ranking(spark: SparkSession, d: str) -> DataFrame:
    fam = _midranked(spark, d).groupBy("family").agg(F.count("*").alias("markers"), F.avg("percentile").alias("percentile"))
    seen = fam.agg(F.avg("percentile"), F.count_if(F.col("percentile") >= 0.9)).first()
    return resampling.random_ranking_test(fam, "family", "markers", seen[0] or 0.0, seen[1] or 0)


# --- views and checks --------------------------------------------------------------------------------------


@query("""SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, sum((n_chars >= 1000)::INT)::BIGINT AS long_documents, round(avg(n_chars), 6) AS mean_chars, max(n_chars) AS longest FROM documents""")
def kpi_cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(
        F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count_if(F.col("n_chars") >= 1000).alias("long_documents"),
        r6(F.avg("n_chars"), "mean_chars"), F.max("n_chars").alias("longest"),
    )


@query("""SELECT event_type AS section, metric, value FROM (UNPIVOT (SELECT event_type, count(*)::VARCHAR AS events, count(DISTINCT user_id)::VARCHAR AS users FROM events GROUP BY 1) ON events, users INTO NAME metric VALUE value)""")
def metric_table(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "events").groupBy(F.col("event_type").alias("section")).agg(F.count("*").cast("string").alias("events"), F.count_distinct("user_id").cast("string").alias("users"))
    return wide.unpivot(["section"], ["events", "users"], "metric", "value")


@query("""SELECT * FROM (SELECT 'order keys are unique' AS "check", (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'quality is 0 or 1', (SELECT count(*) FROM labels WHERE quality IS NULL OR quality NOT IN (0, 1))
UNION ALL SELECT 'values are measurements', (SELECT count(*) FROM events WHERE value IS NULL OR isnan(value) OR isinf(value) OR value < 0)
UNION ALL SELECT 'lines have orders', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)))""")
def audit_checks(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    out = checks.suite(spark, {
        "order keys are unique": checks.duplicates(orders, "o_orderkey"), "quality is 0 or 1": checks.label_violations(table(spark, d, "labels"), "quality"),
        "values are measurements": checks.numeric_violations(table(spark, d, "events"), "value"),
        "lines have orders": lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti"),
    })
    return out.select("check", "violations")


@query("""SELECT count(*) AS cells, sum((b IS NULL)::INT)::BIGINT AS missing, sum((abs(a - b) > 0.00051)::INT)::BIGINT AS beyond, round(max(abs(a - b)), 6) AS largest
FROM (SELECT o_totalprice AS a, CASE WHEN o_orderkey % 6 <> 0 THEN round(o_totalprice / 3, 3) * 3 END AS b FROM orders)""")
def tolerance_difference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    b = a.where("o_orderkey % 6 <> 0").withColumn("v", F.round(F.col("v") / 3, 3) * 3)
    out = checks.tolerance_difference(a, b, ["o_orderkey"], "v", 0.00051)
    return out.select("cells", "missing", "beyond", r6("largest", "largest"))


# --- fits: iterative, checked against in-process versions in the tests ---------------------------------------


@query(None)
def newton_association(spark: SparkSession, d: str) -> DataFrame:
    long = samples(spark, d)
    folds = ranking.hash_folds(long.select("sample", "label").distinct(), F.col("sample").cast("string"), 5, ["label"])
    out = learning.cross_validated_newton(long.join(folds.select("sample", "fold"), "sample"))
    return out.select("feature", *(r6(c, c) for c in ("weight", "bias", "cv_auc", "cv_accuracy", "cv_f1")), "n")


@query(None)
def gd_logistic(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("embedding is not null and label is not null")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    wide = e.select((F.col("label") == 0).cast("double").alias("y"), *(F.element_at("embedding", i + 1).cast("double").alias(f"f{i}") for i in range(size)))
    out = learning.fit_gradient_logistic(wide, [f"f{i}" for i in range(size)], "y")
    return out.select("feature", *(r6(c, c) for c in ("mean", "sd", "weight", "bias")))


@query(None)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return learning.split_frame(rows, "doc_id", "q").select("doc_id", "split")


def curated(spark: SparkSession, d: str) -> DataFrame:
    """A pool of sequences, written once: distinct ones that are not empty, positive if any document with it is."""
    e = entries(spark, d).where(F.length("sequence") > 0).groupBy("sequence").agg(F.max("positive").alias("positive"), F.min("name").alias("name"))
    return materialize(e.select("name", "sequence", sequence.seed(F.col("sequence")).alias("family"), "positive", F.lit(1.0).alias("evidence")))


@query(None)
def ensemble_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct unlabelled sequence, ranked by an ensemble that is fitted on bags."""
    out = learning.rank_candidates(curated(spark, d))
    return ranking.global_rank(out.select("score", "name", "oob_models", "fallback", "median"), [F.desc("score"), F.col("name")]).select(big("rank", "rank"), "name", r6("score", "score"), "oob_models", "fallback", r6("median", "median"))


@query(None)
def nested_validation(spark: SparkSession, d: str) -> DataFrame:
    """Validation of the fit by families: all positives against all other sequences, with all configurations."""
    out = learning.nested_validation(curated(spark, d))
    return out.groupBy("scorer", "fold").agg(F.count("*").alias("n"), r6(F.avg("percentile"), "percentile"))
