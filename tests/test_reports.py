import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.plans import pipelines, reports
from cohortlens.storage import materialize


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(8)
    rows = [(f"s{s:02d}", s % 2, f, float(np.exp(r.normal() + 2 * (s % 2) * (j < 2)))) for s in range(50) for j, f in enumerate(("hsa-mir-1-5p", "hsa-mir-1-3p", "hsa-mir-2", "hsa-let-7a-5p"))]
    long = materialize(spark.createDataFrame(rows, "sample string, label int, feature string, value double"))
    cand = spark.createDataFrame([("hsa-miR-1-5p", "hsa-mir-1-5p", 0.9), ("hsa-miR-2-3p", "hsa-mir-2", 0.5), ("hsa-let-7a-5p", "hsa-let-7a-5p", 0.2)], "candidate string, features string, sequence_score double")
    integrated = materialize(pipelines.validate_candidates(long, cand))
    ranked = integrated.select("candidate", "direction", F.col("integrated_rank").alias("rank"))
    primary = materialize(pipelines.validate_external(long, ranked, "linear"))
    centred = materialize(pipelines.validate_external(long.withColumn("value", F.log2("value")), ranked, "log2", center=True))
    return long, cand, integrated, primary, centred


def test_audit_deliverables_and_views(spark, made):
    _, _, integrated, primary, centred = made
    metrics = reports.deliverables(primary, centred)
    assert metrics.where("metric = 'replicated_exact'").count() == 3
    ranks = integrated.select(F.col("integrated_rank").alias("rank"), F.col("integrated").alias("score"))
    rows = reports.audit(spark, ranks, integrated, primary, metrics).collect()
    assert len(rows) == 10 and all(r["passed"] for r in rows)
    page = reports.dashboard(integrated, primary, centred)
    assert "hsa-miR-1-5p" in page and page.startswith("<!doctype html>")
    cuts = {r["cut"]: r["found"] for r in pipelines.reordered_cutoffs(integrated, primary, "integrated", (1, 3)).collect()}
    assert cuts == {1: 1, 3: 2}


def test_integration_and_shift(spark, made):
    long, cand, *_ = made
    signals = spark.createDataFrame([("hsa-mir-1-5p", -0.4), ("hsa-mir-2", 2.0)], "feature string, weight double")
    got = {r["candidate"]: r for r in reports.integrate_evidence(cand, long, signals).collect()}
    top = got["hsa-miR-1-5p"]
    assert top["rank"] == 1 and abs(top["integrated"] - (0.45 * 0.9 + 0.45 * top["expression_score"] + 0.1 * 0.4)) < 1e-9 and got["hsa-miR-2-3p"]["signal"] == 1.0
    shift, auc = reports.shift_audit(long)
    assert shift.first()["higher"] >= 2 and auc.first()["auc"] > 0.7
    assert {r["feature"]: r["direction"] for r in reports.signal_summary(signals, "feature").collect()} == {"hsa-mir-1-5p": "lower", "hsa-mir-2": "higher"}


def test_one_class_ranking(spark):
    markers = spark.createDataFrame([("m1", "UGAGGUAGUAGGUUGUAUAGUU", 3.0), ("m2", "UGAGGUAGUAGGUUGUGUGGUU", 2.0), ("m3", "UAAAGUGCUUAUAGUGCAGGUAG", 1.0)], "entity string, sequence string, weight double")
    cands = spark.createDataFrame([("near", "UGAGGUAGUAGAUUGUAUAGUU"), ("far", "CCCCCCCCCCCCCCCCCC"), ("short", "A")], "entity string, sequence string")
    got = {r["entity"]: r for r in reports.one_class_ranking(cands, markers, [2, 3], [3]).collect()}
    assert got["near"]["score"] > got["far"]["score"] >= 0 and got["near"]["seed"] == 1.0 and got["near"]["nearest_markers"].startswith("m1:") and got["short"]["centroid"] == 0
    pairs = reports.marker_pairs(markers, [2, 3]).collect()
    assert (pairs[0]["a"], pairs[0]["b"]) == ("m1", "m2")


def test_external_preparation(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 0, 2.0), ("c", 0, 3.0)], "sample_id string, classe int, `hsa-miR-1` double")
    mapping = spark.createDataFrame([("a", "G1", 1, "TS_B: x", "d"), ("b", "G2", 0, "TS_N: y", "d"), ("c", "G3", 0, "TR_N: z", "d")], "sample_id string, gsm string, classe int, titulo_geo string, diagnostico_geo string")
    cohort, kept = reports.prepare_external(rows, mapping, {"TS_B": 1, "TS_N": 1})
    assert sorted(tuple(r) for r in cohort.collect()) == [("G1", 1, 1.0), ("G2", 0, 2.0)] and kept.count() == 2
    with pytest.raises(ValueError):
        reports.prepare_external(rows, mapping.where("sample_id <> 'a'"))
    with pytest.raises(ValueError):
        reports.prepare_external(rows, mapping, {"TS_B": 2})
    official = spark.createDataFrame([("M1", "G1", 1.00002), ("M1", "G2", 2.5)], "row string, sample string, value double")
    got = reports.provenance(cohort, official, spark.createDataFrame([("hsa-miR-1", "M1")], "feature string, row string")).first()
    assert (got["cells"], got["missing"], got["beyond"]) == (2, 0, 1)
    (tmp_path / "w.tsv").write_text("\ta\tb\tc\nU1\t1\t2\t3\n")
    assert reports.unused_subset(spark, str(tmp_path / "w.tsv"), 1, 2).columns == ["", "b", "c"]
