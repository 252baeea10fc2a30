"""Cohort preparation, historical rankings, audits, deliverables and dashboard views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, scores, stats
from ..functions import sequence as S
from ..operators import checks, matching, matrix, ranking, sequences
from ..sources import readers, writers
from .pipelines import external_summary, metric_rows, robust_flags

#: Sample titles of the two groups that the external cohort is made of: a fixed pattern.
COHORT_TITLE = r"^TS_[BN]:"


def unused_subset(spark: SparkSession, path: str, used: int, take: int) -> DataFrame:
    """The id column of a transposed table and ``take`` sample columns after the ``used`` ones."""
    return matrix.slice_columns(readers.read_table(spark, path, "\t"), 1 + used, take)


def one_class_ranking(candidates: DataFrame, markers: DataFrame, sizes: list[int], motif_sizes: list[int], top: int = 3) -> DataFrame:
    """The historical one-class ranking: (entity, score, nearest, ...) of candidates by likeness to weighted markers.

    Both are (entity, sequence); markers have ``weight``. The score is half the cosine with the weighted centroid, and nearest
    marker, motif coverage and seed match for the rest.
    """
    mine, theirs = sequences.kmer_vectors(candidates, sizes), sequences.kmer_vectors(markers, sizes)
    best = sequences.nearest_sequences(candidates, markers, sizes, top, with_seed=False)
    nearest = best.groupBy(F.col("a").alias("entity")).agg(
        F.max("cosine").alias("nearest"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "b", "cosine"))), lambda x: F.concat(x["b"].cast("string"), F.lit(":"), F.round(x["cosine"], 4).cast("string"))), "; ").alias("nearest_markers")
    )
    center = sequences.cosine_to(mine, sequences.centroid(theirs, markers)).withColumnRenamed("cosine", "centroid")
    held, background = sequences.kmer_counts(markers, motif_sizes), sequences.kmer_counts(candidates, motif_sizes)
    motifs = sequences.motif_enrichment(held, background, markers)
    coverage = sequences.motif_coverage(candidates, motifs, motif_sizes)
    seeds = markers.agg(F.collect_set(S.seed(F.col("sequence"))).alias("seeds"))  # one row
    seed = candidates.join(F.broadcast(seeds)).select("entity", F.coalesce(F.array_max(F.transform("seeds", lambda s: S.position_matches(S.seed(F.col("sequence")), s))), F.lit(0.0)).alias("seed"))
    out = candidates.select("entity")
    for part, column in ((center, "centroid"), (nearest, "nearest"), (coverage, "coverage"), (seed, "seed")):
        out = matching.with_default(out, part, ["entity"], {column: 0.0})
    return out.withColumn("score", scores.sequence_score(F.col("centroid"), F.col("nearest"), F.col("coverage"), F.col("seed")))


def marker_pairs(markers: DataFrame, sizes: list[int], top: int = 20) -> DataFrame:
    """The most alike unordered pairs of markers: each is among the ``top`` + 1 nearest, itself included, of its first one."""
    near = sequences.nearest_sequences(markers, markers, sizes, top + 1, with_seed=False)
    return near.where("a < b").orderBy(F.desc(F.round("cosine", 9)), "a", "b").limit(top).select("a", "b", "cosine")


def signal_summary(weights: DataFrame, by: str) -> DataFrame:
    """(by, strongest, direction): largest absolute weight and the sign of the mean weight."""
    return weights.groupBy(by).agg(F.max(F.abs("weight")).alias("strongest"), scores.direction_from_weight(F.avg("weight")).alias("direction"))


def integrate_evidence(candidates: DataFrame, long: DataFrame, signals: DataFrame) -> DataFrame:
    """The historical integration: 0.45 sequence, 0.45 expression, 0.10 baseline-model evidence.

    ``candidates`` is (candidate, features as ``;`` list, sequence_score), ``long`` (sample, label, feature, value), ``signals`` (feature, weight).
    """
    pairs = matching.explode_list(candidates, "features", ";", "feature").select("feature", F.col("candidate").alias("entity")).distinct()
    values = matrix.row_mean(long, pairs).join(long.select("sample", "label").distinct(), "sample").withColumnRenamed("entity", "feature")
    profile = matrix.class_profile(values).join(ranking.auc(values, ["feature"]).select("feature", "auc"), "feature")
    fc, gap = stats.log2_fold_change(F.col("m1"), F.col("m0")), F.col("detect1") - F.col("detect0")
    profile = profile.select(F.col("feature").alias("candidate"), "auc", fc.alias("log2_fold_change"), scores.expression_score(F.col("auc"), fc, gap).alias("expression_score"), scores.direction_from_fold_change(fc).alias("direction"))
    held = pairs.join(signals, "feature").groupBy(F.col("entity").alias("candidate")).agg(F.least(F.lit(1.0), F.max(F.abs("weight"))).alias("signal"))
    out = matching.with_default(candidates.join(profile, "candidate", "left"), held, ["candidate"], {"signal": 0.0, "expression_score": 0.0})
    out = out.withColumn("integrated", scores.blend((0.45, F.col("sequence_score")), (0.45, F.col("expression_score")), (0.1, F.col("signal"))))
    return ranking.sequential_rank(out, [F.desc("integrated"), F.col("candidate")])


def prepare_external(matrix_rows: DataFrame, mapping: DataFrame, expected: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cohort, map): matrix rows of the two cohort groups, re-keyed by accession; the join must be complete.

    ``matrix_rows`` is (sample_id, classe, features...), ``mapping`` (sample_id, gsm, classe, titulo_geo, diagnostico_geo).
    Duplicate ids on either side, rows without a mapping, classes that differ and counts other than ``expected`` (by title prefix) are errors.
    """
    checks.header_contract(matrix_rows, ["sample_id", "classe"])
    for df, key in ((matrix_rows, "sample_id"), (mapping, "sample_id"), (mapping, "gsm")):
        if not checks.duplicates(df, key, fold_case=True).isEmpty():
            raise ValueError(f"{key} repeats")
    m = mapping.select("sample_id", "gsm", F.col("classe").alias("_classe"), "titulo_geo", "diagnostico_geo")
    met = matrix_rows.join(m, "sample_id", "left")
    bad = met.agg(F.count_if(F.col("gsm").isNull()).alias("missing"), F.count_if(F.col("classe") != F.col("_classe")).alias("differing")).first()
    if bad["missing"] or bad["differing"]:
        raise ValueError(f"{bad['missing']} rows without a mapping, {bad['differing']} of another class")
    chosen = met.where(F.col("titulo_geo").rlike(COHORT_TITLE))
    if expected:
        found = {r[0]: r[1] for r in chosen.groupBy(F.substring_index("titulo_geo", ":", 1)).count().collect()}
        if found != expected:
            raise ValueError(f"expected {expected}, found {found}")
    cohort = chosen.select(F.col("gsm").alias("sample_id"), *(F.col(f"`{c}`") for c in matrix_rows.columns[1:]))
    kept = chosen.select(F.col("gsm").alias("sample_id"), F.col("sample_id").alias("source_sample_id"), "classe", F.substring_index("titulo_geo", ":", 1).alias("coorte_original"), "titulo_geo", "diagnostico_geo")
    return cohort, kept


def provenance(cohort: DataFrame, official: DataFrame, accessions: DataFrame, tolerance: float = 0.000051) -> DataFrame:
    """One row: cells of the cohort compared with an official (row, sample, value) matrix through (feature, row) accessions."""
    mine = matrix.to_long(cohort, ["sample_id", "classe"]).select(F.col("sample_id").alias("sample"), names.external_name(F.col("feature")).alias("feature"), F.col("value").try_cast("double").alias("value"))
    keyed = mine.join(accessions.select(names.external_name(F.col("feature")).alias("feature"), "row"), "feature").select("row", "sample", "value")
    return checks.tolerance_difference(keyed, official.select("row", "sample", "value"), ["row", "sample"], "value", tolerance)


def shift_audit(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shift, auc): per-feature differences in one row, and how well a sample's mean over all features separates the classes."""
    means = long.groupBy("sample", "label").agg(F.avg("value").alias("value")).withColumn("feature", F.lit("mean of all features"))
    return matrix.global_shift(matrix.class_profile(long)), ranking.auc(means, ["feature"])


def deliverables(primary: DataFrame, centred: DataFrame) -> DataFrame:
    """The consolidated metric table (section, metric, value, analysis) of both external analyses and their intersection."""
    flags = robust_flags(primary, centred)
    both = flags.agg(F.count_if("robust").alias("replicated_exact"), F.count_if("practical_both").alias("practical"), F.count_if("strict").alias("unambiguous"))
    out = metric_rows("external", external_summary(primary), "primary").unionByName(metric_rows("external", external_summary(centred), "centred"))
    return out.unionByName(metric_rows("external", both, "both"))


def audit(spark: SparkSession, sequence_ranking: DataFrame, integrated: DataFrame, external: DataFrame, metrics: DataFrame) -> DataFrame:
    """The expectation suite over what the pipelines made: (check, violations, passed)."""
    unit = lambda df, c: df.where(~F.col(c).between(0, 1) | F.isnan(c))
    shared = external.where("fdr is not null").groupBy("hypothesis").agg(F.count_distinct("fdr").alias("k")).where("k > 1")
    return checks.suite(spark, {
        "sequence ranks are contiguous and scores descend": checks.rank_violations(sequence_ranking, "rank", "score"),
        "candidates are unique": checks.duplicates(integrated, "candidate"),
        "integrated ranks are contiguous": checks.rank_violations(integrated, "integrated_rank", "integrated"),
        "AUC is from 0 to 1": unit(integrated, "cv_auc"), "FDR is from 0 to 1": unit(integrated, "fdr"),
        "FDR is not below p": integrated.where(F.col("fdr") < F.col("p_value") - 1e-15),
        "one FDR for a hypothesis": shared,
        "replication is exact, proxy or absent": external.where(~F.col("method").isin("exact", "family", "absent")),
        "strict replications are replications": external.where(F.col("unambiguous") & ~F.col("replicated_exact")),
        "metrics are unique": metrics.groupBy("metric", "analysis").count().where("count > 1"),
    })


def key_figures(integrated: DataFrame, external: DataFrame) -> DataFrame:
    """One row of the dashboard's cards."""
    a = integrated.agg(
        F.count("*").alias("candidates"), F.count_if(F.col("fdr") < 0.05).alias("significant"), F.count_if("pareto").alias("front"), F.count_if(F.col("sharing") > 1).alias("ambiguous"),
        F.avg(F.nanvl("cv_auc", F.lit(None).cast("double"))).alias("mean_auc"), F.max("integrated").alias("best"),
    )
    return a.join(F.broadcast(external_summary(external).withColumnRenamed("candidates", "external_candidates")))


def views(integrated: DataFrame, external: DataFrame, centred: DataFrame) -> dict[str, DataFrame]:
    """The dashboard's tables, each in its default order, the scatter and the top bars."""
    flags = robust_flags(external, centred).select("candidate", "robust", "strict", "practical_both")
    main = integrated.join(flags, "candidate", "left").na.fill(False, ["robust", "strict", "practical_both"])
    short = lambda df: df.select("candidate", "method", F.round("auc", 4).alias("auc"), F.round("fdr", 6).alias("fdr"), "replicated_exact", "unambiguous")
    return {
        "integrated": main.orderBy("integrated_rank").select("integrated_rank", "candidate", F.round("integrated", 4).alias("integrated"), "pareto", "robust", "strict"),
        "validation": main.orderBy("validation_rank").select("validation_rank", "candidate", F.round("cv_auc", 4).alias("cv_auc"), F.round("fdr", 6).alias("fdr"), "direction"),
        "sequence": main.orderBy(F.desc("sequence_score"), "candidate").select("candidate", F.round("sequence_score", 4).alias("sequence_score")),
        "external": short(external).orderBy(F.desc("auc"), "candidate"), "centred": short(centred).orderBy(F.desc("auc"), "candidate"),
        "scatter": main.select("candidate", "sequence_score", "validation_score", "pareto"), "top": main.orderBy("integrated_rank").select("candidate", "integrated").limit(20),
    }


def dashboard(integrated: DataFrame, external: DataFrame, centred: DataFrame, title: str = "Rankings") -> str:
    return writers.dashboard(title, {"key figures": key_figures(integrated, external), **views(integrated, external, centred)})
