"""Whole pipelines: from matrices and sequences to rankings, an external validation, sensitivity variants and deliverables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, scores, stats
from ..operators import checks, learning, matching, matrix, ranking, resampling
from ..storage import materialize
from .ledger import Ledger


def build_matrix(cases: DataFrame, controls: DataFrame, mapping: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(long, common): cases (sample_id, classe, features...) with as many controls, transposed rows summed per feature.

    ``controls`` is (row, sample, value), ``mapping`` (row, name). A row counts for each feature that its name's base matches itself or
    without its locus number. ``common`` lists the features that both sides have.
    """
    checks.header_contract(cases, ["sample_id", "classe"])
    features = cases.columns[2:]
    known = cases.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    keyed = mapping.withColumn("base", names.mature_base(names.lower_name(F.col("name"))))
    pairs = matching.match_either(keyed, known, "base", [F.col("feature"), names.precursor_family(F.lower("feature"))]).select("row", "feature").distinct()
    chosen = controls.select("sample").distinct().orderBy("sample").limit(count)
    rows = controls.join(chosen, "sample", "left_semi")
    control_long = matrix.transpose_sum(rows, pairs, "row", "sample", "value").select(F.col("sample").alias("sample_id"), F.lit(0).alias("classe"), "feature", "value")
    case_long = matrix.to_long(cases, ["sample_id", "classe"], features)
    case_long = case_long.select("sample_id", F.col("classe").cast("int").alias("classe"), "feature", stats.lenient_number(F.col("value").cast("string")).alias("value"))
    common = control_long.select("feature").distinct().join(case_long.select("feature").distinct(), "feature", "left_semi")
    return case_long.unionByName(control_long), common


def train_baseline(wide: DataFrame, label: str = "classe", id_column: str = "sample_id", **options: float) -> tuple[DataFrame, DataFrame]:
    """(model, scored): the batch logistic model on a stratified split and the scores of the test rows."""
    features = [c for c in wide.columns if c not in (id_column, label)]
    logged = wide.select(id_column, label, *(stats.log1p_scale(F.col(f"`{c}`").cast("double")).alias(c) for c in features))
    split = materialize(learning.split_frame(wide, id_column, label).select(id_column, "split"))
    parts = logged.join(split, id_column)
    model = learning.fit_gradient_logistic(parts.where("split = 'train'"), features, label, **options)
    rows = {r["feature"]: r for r in model.collect()}
    spec = {"features": features, "means": [rows[f]["mean"] for f in features], "stds": [rows[f]["sd"] for f in features], "weights": [rows[f]["weight"] for f in features], "bias": next(iter(rows.values()))["bias"]}
    raw = wide.join(split, id_column).where("split = 'test'")
    return model, learning.score(raw, spec).select(id_column, label, "probability", "predicted")


def panel_matrix(long: DataFrame, panel: DataFrame) -> DataFrame:
    """(sample, entity, value): a panel's markers as log1p means of their source columns; ``panel`` is (entity, feature)."""
    out = matrix.row_mean(long, panel)
    return out.withColumn("value", stats.log1p_scale(F.col("value")))


def apply_policy(markers: DataFrame, policy: DataFrame) -> DataFrame:
    """The markers that a training policy uses, with its weight as ``evidence``; the two must name the same markers, each once.

    ``markers`` has ``name``, ``policy`` is (name, training_weight, use_in_training: sim or nao). Other flags and weights
    that are not above 0 are errors too.
    """
    _, problems = matching.one_to_one(markers, policy, "name")
    flag, weight = F.lower(F.trim("use_in_training")), F.col("training_weight").try_cast("double")
    odd = policy.where(~F.coalesce(flag.isin("sim", "nao"), F.lit(False)) | ~F.coalesce(weight > 0, F.lit(False)))
    bad = problems.unionByName(odd.select("name", F.lit("unknown flag or weight").alias("problem"))).orderBy("name").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['name']}: {r['problem']}" for r in bad))
    used = policy.where(flag == "sim").select("name", weight.alias("evidence"))
    return markers.drop("evidence").join(used, "name")


def rank_sequences(entries: DataFrame, **options: object) -> DataFrame:
    """Model 1: candidates by out-of-bag score, ties by name, with ranks and percentiles; entries as in ``learning.rank_candidates``."""
    out = materialize(learning.rank_candidates(entries, **options))
    ranked = ranking.global_rank(out, [F.desc("score"), F.col("name")])
    n = F.lit(out.count())
    return ranked.withColumn("percentile", F.when(n <= 1, 1.0).otherwise((n - F.col("rank")) / F.greatest(n - 1, F.lit(1))))


def validate_candidates(long: DataFrame, candidates: DataFrame) -> DataFrame:
    """Model 2: (candidate, features, sequence_score) tested one by one on cases and controls, with integrated ranks.

    ``long`` is (sample, label, feature, value) on a linear scale, ``candidates.features`` a ``;`` list. Candidates without any
    of their features in the data go. Every distinct feature set is fitted once.
    """
    exploded = matching.explode_list(candidates, "features", ";", "feature").join(long.select("feature").distinct(), "feature", "left_semi")
    held = exploded.groupBy("candidate").agg(F.sort_array(F.collect_set("feature")).alias("set"))
    held = held.withColumn("hypothesis", F.array_join("set", "|"))
    sets = held.select("hypothesis", F.explode("set").alias("feature")).distinct()
    values = matrix.row_mean(long, sets.select("feature", F.col("hypothesis").alias("entity"))).withColumnRenamed("entity", "hypothesis")
    values = values.join(long.select("sample", "label").distinct(), "sample").withColumn("raw", F.col("value")).withColumn("value", F.log1p("value"))
    folds = ranking.hash_folds(values.select("sample", "label").distinct(), F.col("sample").cast("string"), 5, ["label"]).select("sample", "fold")
    fits = learning.cross_validated_newton(values.join(folds, "sample").select(F.col("hypothesis").alias("feature"), "label", "fold", "value"))
    profile = matrix.class_profile(values.select(F.col("hypothesis").alias("feature"), "label", F.col("raw").alias("value")))
    tested = fits.join(profile, "feature").withColumn("auc", F.col("cv_auc"))
    tested = ranking.benjamini_hochberg(ranking.auc_inference(tested)).withColumnRenamed("feature", "hypothesis")
    fc, gap = stats.log2_fold_change(F.col("m1"), F.col("m0")), F.col("detect1") - F.col("detect0")
    out = candidates.join(held, "candidate").join(tested, "hypothesis").withColumn("log2_fold_change", fc)
    out = out.withColumn("validation_score", scores.validation_score(F.col("cv_auc"), fc, gap)).withColumn("direction", scores.direction_from_weight(F.col("weight")))
    both = ((0.5, F.col("sequence_score")), (0.5, F.col("validation_score")))
    out = out.withColumn("integrated", scores.blend(*both))
    for name, a, b in (("sequence_first", 0.75, 0.25), ("validation_first", 0.25, 0.75)):
        out = out.withColumn(name, scores.blend((a, F.col("sequence_score")), (b, F.col("validation_score"))))
    out = ranking.sequential_rank(out, [F.desc("integrated"), F.desc("validation_score"), F.col("candidate")], name="integrated_rank")
    out = ranking.sequential_rank(out, [F.desc("validation_score"), F.desc("cv_auc"), F.desc(F.abs("log2_fold_change")), F.desc("sequence_score"), F.col("candidate")], name="validation_rank")
    front = ranking.pareto_front(out, "sequence_score", "validation_score").select("candidate", F.lit(True).alias("pareto"))
    sharing = out.groupBy("hypothesis").agg(F.count("*").alias("sharing"))
    return matching.with_default(out.join(sharing, "hypothesis"), front, ["candidate"], {"pareto": False})


def validate_external(long: DataFrame, ranked: DataFrame, scale: str, center: bool = False) -> DataFrame:
    """The frozen ranking (candidate, direction, rank) on another cohort: coverage, directed AUC, FDR over distinct hypotheses, verdicts.

    ``long`` is (sample, label, feature, value). Values are centred on all of a sample's features before any feature goes.
    """
    data = matrix.center_by_sample(long) if center else long
    columns = data.select("feature").distinct().select(F.col("feature").alias("column"), names.external_name(F.col("feature")).alias("key"), names.external_family(F.col("feature")).alias("family"))
    named = ranked.withColumn("key", names.external_name(F.col("candidate"))).withColumn("family", names.external_family(F.col("candidate")))
    mapped = matching.exact_or_all_family(named, columns, "key", "family")
    lower = F.coalesce(F.col("direction") == "lower", F.lit(False))
    mapped = mapped.withColumn("hypothesis", F.concat_ws("|", F.array_join(F.sort_array("columns"), "|"), F.when(lower, "lower").otherwise("higher")))
    pairs = mapped.select("hypothesis", F.explode("columns").alias("feature")).distinct().withColumnRenamed("hypothesis", "entity")
    values = matrix.row_mean(data, pairs).join(data.select("sample", "label").distinct(), "sample")
    values = values.withColumn("value", F.log1p("value") if scale == "linear" else F.col("value")).withColumnRenamed("entity", "feature")
    plain = ranking.auc(values, ["feature"]).join(matrix.class_profile(values).drop("n1", "n0"), "feature")
    turned = F.col("feature").endswith("|lower")
    tested = ranking.auc_inference(plain.withColumn("auc", F.when(turned, 1 - F.col("auc")).otherwise(F.col("auc"))))
    tested = ranking.benjamini_hochberg(tested).withColumnRenamed("feature", "hypothesis")
    out = mapped.join(tested, "hypothesis", "left")
    sharing = mapped.where("method <> 'absent'").groupBy("hypothesis").agg(F.count("*").alias("sharing"))
    out = out.join(sharing, "hypothesis", "left")
    ok = F.coalesce(scores.replicated(F.col("n1"), F.col("n0"), F.col("auc") > 0.5, F.col("ci_low"), F.col("fdr")), F.lit(False))
    exact = F.col("method") == "exact"
    return out.withColumns({
        "replicated": ok, "replicated_exact": ok & exact, "practical": ok & exact & (F.col("auc") >= 0.6), "unambiguous": ok & exact & (F.col("sharing") == 1),
    })


def external_summary(validated: DataFrame) -> DataFrame:
    """One row of coverage and replication counts, exact and proxy apart."""
    c = lambda cond, name: F.count_if(cond).alias(name)
    m = F.col("method")
    return validated.agg(
        F.count("*").alias("candidates"), c(m == "exact", "exact"), c(m == "family", "proxy"), c(m == "absent", "absent"), F.count_distinct("hypothesis").alias("hypotheses"),
        c(F.col("replicated_exact"), "replicated_exact"), c(F.col("replicated") & (m == "family"), "replicated_proxy"), c(F.col("practical"), "practical"), c(F.col("unambiguous"), "unambiguous"),
    )


def robust_flags(primary: DataFrame, centred: DataFrame) -> DataFrame:
    """Candidates with their verdicts in both analyses: robust in both, strict core, AUC of 0.60 in both."""
    other = centred.select("candidate", *(F.col(c).alias(f"_{c}") for c in ("replicated_exact", "practical", "unambiguous")))
    out = primary.join(other, "candidate", "left")
    both = lambda c: F.coalesce(F.col(c) & F.col(f"_{c}"), F.lit(False))
    return out.withColumns({"robust": both("replicated_exact"), "strict": both("unambiguous"), "practical_both": both("practical")}).drop("_replicated_exact", "_practical", "_unambiguous")


def changed_entries(entries: DataFrame, weights: dict[str, float], variant: str = "variant") -> DataFrame:
    """Entries with markers dropped (weight 0) or re-weighted. A name that is no marker is an error."""
    lacking = checks.contained(list(weights), entries.where("positive = 1"), "name")
    if lacking:
        raise ValueError(f"{variant}: {lacking}")
    if not weights:
        return entries
    table = entries.sparkSession.createDataFrame(list(weights.items()), "name string, _w double")
    return entries.join(F.broadcast(table), "name", "left").withColumn("evidence", F.coalesce("_w", "evidence")).where(F.coalesce("_w", F.lit(1.0)) > 0).drop("_w")


def sensitivity(entries: DataFrame, variants: dict[str, dict[str, float]], ledger: Ledger | None = None, **options: object) -> DataFrame:
    """(variant, family, percentile) of nested validation with markers dropped (weight 0) or re-weighted, variant by variant.

    A variant must change the markers it names, each once; a name that is not there is an error. With a ``ledger`` a variant that is
    finished is read from it, so a run that was stopped goes on where it was; weights and options are part of a variant's key.
    """
    out = None
    for variant, weights in variants.items():
        changed = changed_entries(entries, weights, variant)

        def part(changed: DataFrame = changed) -> DataFrame:
            return learning.nested_validation(changed, **options).where("scorer = 'ensemble'").groupBy("family").agg(F.avg("percentile").alias("percentile"))

        got = ledger.run(f"sensitivity {variant}", part, [weights, {k: str(v) for k, v in options.items()}]) if ledger else part()
        got = got.withColumn("variant", F.lit(variant))
        out = got if out is None else out.unionByName(got)
    return out


def sensitivity_ranks(entries: DataFrame, long: DataFrame, features: DataFrame, external: DataFrame, variants: dict[str, dict[str, float]], ledger: Ledger, **options: object) -> DataFrame:
    """(variant, cut, found, replicated, practical): Models 1 and 2 of each variant, and what the external data replicate of their first candidates.

    ``features`` is (name, features as ``;`` list) for Model 2, ``external`` an external validation that is not made anew: its verdicts are
    put in the variant's order. Each model of each variant is a part of the ledger.
    """
    out = None
    for variant, weights in variants.items():
        key = [weights, {k: str(v) for k, v in options.items()}]
        changed = changed_entries(entries, weights, variant)
        first = ledger.run(f"model 1 {variant}", lambda changed=changed: rank_sequences(changed, **options).select("name", "rank", "percentile"), key)
        candidates = first.join(features, "name").select(F.col("name").alias("candidate"), "features", F.col("percentile").alias("sequence_score"))
        second = ledger.run(f"model 2 {variant}", lambda candidates=candidates: validate_candidates(long, candidates).select("candidate", "integrated", "integrated_rank"), key)
        got = reordered_cutoffs(second, external, "integrated").withColumn("variant", F.lit(variant))
        out = got if out is None else out.unionByName(got)
    return out


def reordered_cutoffs(ranked: DataFrame, external: DataFrame, score: str, cuts: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """(cut, found, replicated, practical): the first K by a score, sorted anew, and what of them the external data replicate exactly."""
    top = ranked.orderBy(F.desc(score), "candidate").limit(max(cuts))
    top = ranking.sequential_rank(top, [F.desc(score), F.col("candidate")], name="_k")
    met = top.join(external.select("candidate", "method", "replicated_exact", "practical"), "candidate", "left")
    cut = met.withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).where(F.col("_k") <= F.col("cut"))
    return cut.groupBy("cut").agg(F.count_if(F.col("method") == "exact").alias("found"), F.count_if("replicated_exact").alias("replicated"), F.count_if("practical").alias("practical"))


def compare_variants(results: DataFrame, reference: str, other: str, seed: int = 1) -> DataFrame:
    """Paired differences of two variants over the families both have."""
    a = results.where(F.col("variant") == reference).select("family", F.col("percentile").alias("a"))
    b = results.where(F.col("variant") == other).select("family", F.col("percentile").alias("b"))
    return resampling.paired_comparison(a.join(b, "family").select("family", (F.col("b") - F.col("a")).alias("delta")), "family", "delta", seed, seed + 1)


def metric_rows(section: str, summary: DataFrame, analysis: str) -> DataFrame:
    """(section, metric, value as text, analysis) of a one-row summary: a part of the consolidated table."""
    text = summary.select(*(F.col(c).cast("string").alias(c) for c in summary.columns))
    return text.unpivot([], text.columns, "metric", "value").select(F.lit(section).alias("section"), "metric", "value", F.lit(analysis).alias("analysis"))
