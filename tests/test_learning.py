import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.hashing import counter_uniform_at, counter_uniform_np
from cohortlens.operators import checks, learning, matching, resampling, sequences
from cohortlens.plans import pipelines
from cohortlens.streaming import scoring


def test_newton_reaches_the_optimum(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=200)
    y = (r.random(200) < 1 / (1 + np.exp(-2 * v))).astype(float)
    w, b, c, s = learning.newton_logistic(v, y)
    x = (v - c) / s
    p = 1 / (1 + np.exp(-(w * x + b)))
    assert abs(((p - y) * x).sum() + 0.01 * 200 * w) < 1e-5 and abs((p - y).sum()) < 1e-5
    rows = [("f", int(l), int(i % 5), float(z)) for i, (z, l) in enumerate(zip(v, y))]
    out = learning.cross_validated_newton(spark.createDataFrame(rows, "feature string, label int, fold int, value double")).first()
    assert abs(out["weight"] - w) < 1e-9 and out["n"] == 200 and 0.7 < out["cv_auc"] < 1


def test_gradient_fit_and_score(spark):
    r = np.random.default_rng(1)
    rows = [(float(a), float(b), int(a + b > 0)) for a, b in r.normal(size=(100, 2))]
    model = learning.fit_gradient_logistic(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y", epochs=200).orderBy("feature").collect()
    x = np.array([t[:2] for t in rows])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w, b = learning.gradient_logistic(z, np.array([t[2] for t in rows], float), epochs=200)
    assert np.allclose([m["weight"] for m in model], w) and abs(model[0]["bias"] - b) < 1e-12


def test_split_is_stratified():
    split = learning.stratified_split([(i, i % 3 == 0) for i in range(60)])
    assert sum(v == "test" for v in split.values()) == 12 and sum(v == "test" for k, v in split.items() if k % 3 == 0) == 4


@pytest.mark.parametrize("held_bytes", [1 << 20, 0])
def test_gradient_fit_is_the_same_dealt_over_tasks(spark, held_bytes):
    r = np.random.default_rng(7)
    x = r.normal(size=(900, 3)) * [1, 5, 0]  # a column without spread
    y = (x[:, 0] + r.normal(size=900) > 0).astype(float)
    rows = [(*map(float, v), float(t), "z") for v, t in zip(x, y, strict=True)]
    odd = [(None, 1.0, 1.0, 1.0, "z"), (float("nan"), 1.0, 1.0, 0.0, "z"), (1.0, 2.0, float("inf"), 0.0, "z"), (1.0, 1.0, 1.0, None, "z")]
    df = spark.createDataFrame(rows + odd, "a double, b double, `c.d` double, y double, weight string")
    got = {m["feature"]: m for m in learning.fit_gradient_logistic(df, ["a", "b", "c.d"], "y", epochs=40, held_bytes=held_bytes).collect()}
    sd = np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1.0)
    w, b = learning.gradient_logistic((x - x.mean(0)) / sd, y, epochs=40)
    assert all(abs(got[f]["weight"] - v) < 1e-9 and abs(got[f]["bias"] - b) < 1e-9 for f, v in zip(["a", "b", "c.d"], w, strict=True))
    assert learning.fit_gradient_logistic(df.limit(0), ["a"], "y").count() == 0


def test_newton_fits_equal_one_fit_a_feature(spark):
    r = np.random.default_rng(10)
    rows, want = [], {}
    for f in range(4):
        v, fold = r.normal(size=90).round(1), np.arange(90) % 3
        y = (r.random(90) < 1 / (1 + np.exp(-f * v))).astype(float) if f < 3 else (v > 0).astype(float)  # the last is separable
        v = np.zeros(90) if f == 0 else v  # the first has no spread
        rows += [(f"f{f}", int(t), int(k), float(x)) for x, t, k in zip(v, y, fold, strict=True)]
        p = np.zeros(90)
        for k in range(3):
            w, b, c, s = learning.newton_logistic(v[fold != k], y[fold != k])
            p[fold == k] = learning.sigmoid(w * (v[fold == k] - c) / s + b)
        hit = p >= 0.5
        want[f"f{f}"] = (*learning.newton_logistic(v, y), learning.tie_auc(p, y), (hit == (y == 1)).mean(), 2 * (hit & (y == 1)).sum() / max(1, hit.sum() + y.sum()))
    df = spark.createDataFrame(rows, "feature string, label int, fold int, value double")
    got = {x["feature"]: x for x in learning.cross_validated_newton(df).collect()}
    assert set(got) == set(want)
    for f, x in want.items():
        assert np.allclose([got[f][c] for c in ("weight", "bias", "center", "scale", "cv_auc", "cv_accuracy", "cv_f1")], x, atol=1e-6), f
    with pytest.raises(ValueError, match="lacks a class"):
        learning.cross_validated_newton(df.where("fold > 0 or label = 1"))


def test_split_of_a_frame_is_the_sequential_one(spark):
    keys = [(i * 3 % 101, (i * 7) % 3) for i in range(101)]
    df = spark.createDataFrame(keys, "id long, label int")
    got = {r["id"]: r["split"] for r in learning.split_frame(df, "id", "label", 0.3, 9).collect()}
    assert got == learning.stratified_split(sorted(keys), 0.3, 9)
    assert learning.split_frame(df.limit(0), "id", "label").count() == 0


def test_vectors_agree_with_the_frame_version(spark):
    s = "UGAGGUAGUAGGUUGUAUAGUU"
    df = spark.createDataFrame([("e", s)], "entity string, sequence string")
    for blocks in ("core", "composition", "positional", "terminals", "full"):
        got = {r["feature"]: r["value"] for r in sequences.feature_vectors(df, [2, 3, 4], blocks).collect()}
        want = learning.sequence_features(s, (2, 3, 4), blocks)
        assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-12 for f in want)


def pool(spark, n=60):
    r = np.random.default_rng(2)
    rows = []
    for i in range(n):
        s = "".join(r.choice(list("ACGU"), 20))
        if i < 12:
            s = s[:1] + ("GAGGUAG", "CCCUGAG", "AAAGUGC")[i % 3] + s[8:]
        rows.append((f"m{i:03d}", s, s[1:8], int(i < 12), 1.0 + i % 2))
    return spark.createDataFrame(rows, "name string, sequence string, family string, positive int, evidence double")


def test_ensemble_and_nested_validation(spark):
    entries = pool(spark)
    out = pipelines.rank_sequences(entries, bags=4, size=20, epochs=20).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 49)) and out[0]["percentile"] == 1.0 and out[-1]["percentile"] == 0.0
    assert all(a["score"] >= b["score"] for a, b in zip(out, out[1:])) and all(0 <= r["oob_models"] <= 4 for r in out)
    nested = learning.nested_validation(entries, configs=learning.CONFIGS[:2], bags=1, size=20, epochs=10)
    rows = nested.collect()
    assert {r["scorer"] for r in rows} >= {"ensemble", "seed", "centroid", "composition", "hash", "ablation:core"}
    assert all(0 <= r["percentile"] <= 1 for r in rows)
    assert learning.choose_configuration(nested).count() == 1


def test_resampling(spark, monkeypatch):
    values = [0.2, 0.95, 0.5, 0.9]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    u = counter_uniform_np(7, 50 * 4).reshape(50, 4)
    want = np.array(values)[(u * 4).astype(int)]
    got = resampling.bootstrap_means(df, "k", "v", 7, 50).orderBy("iteration").collect()
    assert np.allclose([r["mean"] for r in got], want.mean(1)) and np.allclose([r["recall"] for r in got], (want >= 0.9).mean(1))
    flips = np.where(counter_uniform_np(9, 400).reshape(100, 4) < 0.5, values, -np.array(values)).mean(1)
    p = resampling.paired_comparison(df, "k", "v", 8, 9, 20, 100).first()
    assert abs(p["p_value"] - ((np.abs(flips) >= np.mean(values)).sum() + 1) / 101) < 0.02 and p["improved"] == 4
    counts = spark.createDataFrame([(0, 2), (1, 1)], "k int, c long")
    for piece, draws in ((1 << 16, 1 << 20), (1, 3)):  # whole families, and families in pieces
        monkeypatch.setattr(resampling, "PIECE", piece)
        monkeypatch.setattr(resampling, "DRAWS", draws)
        got = resampling.random_ranking_test(counts, "k", "c", 0.5, 1, 5, 40).first()
        assert resampling.random_ranking_test(counts.where("k = 0"), "k", "c", 0.0, 0, 5, 40).first()["p_mean"] == 1
    assert resampling.random_ranking_test(counts.limit(0), "k", "c", 0.5, 1, 5, 40).first()["p_mean"] == 1
    u = counter_uniform_np(5, 40 * 3).reshape(40, 3)
    fam = np.column_stack([u[:, :2].mean(1), u[:, 2]])
    assert abs(got["p_mean"] - ((fam.mean(1) >= 0.5).sum() + 1) / 41) < 1e-9 and abs(got["p_recall"] - (((fam >= 0.9).sum(1) >= 1).sum() + 1) / 41) < 1e-9


def test_paired_comparison_of_many_families_takes_seconds(spark):
    """14,000 iterations over 1,500 families; sums are those of a loop over the families, as are ties with what was observed."""
    vs = np.round(np.random.default_rng(6).normal(0.01, 0.4, 1500), 2)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(vs)], "k int, v double").repartition(3)
    begun = time.monotonic()
    got = resampling.paired_comparison(df, "k", "v", 8, 9).first()
    assert time.monotonic() - begun < 60
    total = np.zeros(10_000)
    for j, v in enumerate(vs):
        total += np.where(counter_uniform_at(9, np.arange(10_000) * 1500 + j) < 0.5, v, -v)
    assert got["p_value"] == ((np.abs(total / 1500) >= abs(np.cumsum(vs)[-1] / 1500)).sum() + 1) / 10_001
    drawn = vs[(counter_uniform_np(8, 4000 * 1500) * 1500).astype(int)].reshape(4000, 1500).mean(axis=1)
    assert abs(got["ci_low"] - np.quantile(drawn, 0.025)) < 1e-9 and abs(got["ci_high"] - np.quantile(drawn, 0.975)) < 1e-9


def test_checks_and_joins(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([("x",), ("z",)], "k string")
    joined, bad = matching.one_to_one(a, b, "k")
    assert joined.count() == 2 and {r["k"]: r["problem"] for r in bad.collect()} == {"x": "duplicate on the left", "y": "missing on the right", "z": "unused on the right"}
    assert checks.duplicates(a, "k").count() == 1 and checks.contained(["x", "q"], a, "k") == ["q"]
    ranks = spark.createDataFrame([(1, 0.9), (2, 0.95), (4, 0.1)], "rank int, s double")
    assert sorted(r["rank"] for r in checks.rank_violations(ranks, "rank", "s").collect()) == [2, 4]
    assert checks.same_frame(a, a) and not checks.same_frame(a, a.limit(1))
    assert [r["n"] for r in checks.group_sizes(spark.createDataFrame([(1,), (1,)], "y int"), "y").collect()] == [0]


def test_model_two_and_external(spark):
    r = np.random.default_rng(3)
    rows = []
    for s in range(60):
        for j, f in enumerate(("hsa-mir-1-5p", "hsa-mir-1-3p", "hsa-mir-2", "hsa-let-7a-5p")):
            rows.append((f"s{s:02d}", s % 2, f, float(np.exp(r.normal() + 2 * (s % 2) * (j < 2)))))
    long = spark.createDataFrame(rows, "sample string, label int, feature string, value double")
    cand = spark.createDataFrame([("a", "hsa-mir-1-5p; hsa-mir-1-3p", 0.9), ("b", "hsa-mir-2", 0.5), ("c", "hsa-mir-1-3p;hsa-mir-1-5p", 0.1), ("d", "none", 0.3)], "candidate string, features string, sequence_score double")
    out = {x["candidate"]: x for x in pipelines.validate_candidates(long, cand).collect()}
    assert set(out) == {"a", "b", "c"} and out["a"]["cv_auc"] == out["c"]["cv_auc"] > out["b"]["cv_auc"] and out["a"]["sharing"] == 2
    assert out["a"]["integrated_rank"] == 1 and out["a"]["pareto"] and not out["c"]["pareto"]
    ranked = spark.createDataFrame([("hsa-miR-1-5p", "higher", 1), ("hsa-miR-2-3p", "lower", 2), ("hsa-miR-9", None, 3)], "candidate string, direction string, rank int")
    got = pipelines.validate_external(long, ranked, "linear")
    by = {x["candidate"]: x for x in got.collect()}
    assert by["hsa-miR-1-5p"]["method"] == "exact" and by["hsa-miR-1-5p"]["replicated_exact"] and by["hsa-miR-9"]["method"] == "absent"
    total = pipelines.external_summary(got).first()
    assert (total["exact"], total["proxy"], total["absent"]) == (1, 1, 1)
    both = pipelines.robust_flags(got, pipelines.validate_external(long, ranked, "linear", center=True))
    assert both.count() == 3
    assert pipelines.metric_rows("s", pipelines.external_summary(got), "primary").count() == 9


def test_build_matrix(spark):
    cases = spark.createDataFrame([("c1", "1", "5", "1"), ("c2", "1", "x", "2")], "sample_id string, classe string, `hsa-mir-1` string, `hsa-mir-2-1` string")
    controls = spark.createDataFrame([("U1", "h1", 2.0), ("U2", "h1", 3.0), ("U3", "h1", 4.0), ("U1", "h2", 1.0)], "row string, sample string, value double")
    mapping = spark.createDataFrame([("U1", "hsa-miR-1-5p"), ("U2", "hsa-miR-1-3p"), ("U3", "hsa-miR-2-5p")], "row string, name string")
    long, common = pipelines.build_matrix(cases, controls, mapping, 1)
    got = {(r["sample_id"], r["feature"]): r["value"] for r in long.collect()}
    assert got[("h1", "hsa-mir-1")] == 5.0 and got[("h1", "hsa-mir-2-1")] == 4.0 and got[("c2", "hsa-mir-1")] == 0.0 and ("h2", "hsa-mir-1") not in got
    assert common.count() == 2


def test_baseline_pipeline_equals_a_plain_version(spark):
    r = np.random.default_rng(5)
    rows = [(f"s{i:02d}", i % 2, float(r.random() + (i % 2) * 3), float(r.random())) for i in range(60)]
    model, scored = pipelines.train_baseline(spark.createDataFrame(rows, "sample_id string, classe int, f1 double, f2 double"), epochs=300)
    split = learning.stratified_split([(i, y) for i, y, _, _ in sorted(rows)])
    x, y = np.log1p([t[2:] for t in sorted(rows)]), np.array([t[1] for t in sorted(rows)], float)
    train = np.array([split[t[0]] == "train" for t in sorted(rows)])
    mean, sd = x[train].mean(0), x[train].std(0, ddof=1)
    w, b = learning.gradient_logistic((x[train] - mean) / sd, y[train], epochs=300)
    fitted = {m["feature"]: m for m in model.collect()}
    assert np.allclose([fitted[f]["weight"] for f in ("f1", "f2")], w, atol=1e-9) and abs(fitted["f1"]["bias"] - b) < 1e-9
    p = learning.sigmoid((x - mean) / sd @ w + b)
    got = {t["sample_id"]: (t["probability"], t["predicted"]) for t in scored.collect()}
    assert set(got) == {i for i, s in split.items() if s == "test"}
    assert all(abs(got[t[0]][0] - q) < 2e-6 and got[t[0]][1] == int(q >= 0.5) for t, q in zip(sorted(rows), p, strict=True) if t[0] in got)


def test_sensitivity(spark):
    got = pipelines.sensitivity(pool(spark), {"all": {}, "less": {"m000": 0.0, "m001": 2.0}}, configs=learning.CONFIGS[:1], bags=1, size=20, epochs=8)
    assert {r["variant"] for r in got.collect()} == {"all", "less"}
    assert pipelines.compare_variants(got, "all", "less").count() == 1


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("sample_id,f1\ns1,3\ns2,\n")
    model = {"features": ["f1"], "means": [0.5], "stds": [1.0], "weights": [2.0], "bias": -0.5}
    q = scoring.score_stream(spark, str(tmp_path / "in"), "sample_id string, f1 double", model, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = {r["sample_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = learning.score(spark.read.schema("sample_id string, f1 double").option("header", True).csv(str(tmp_path / "in")), model)
    assert {r["sample_id"]: r["probability"] for r in batch.collect()} == {k: v["probability"] for k, v in got.items()}
    events = spark.createDataFrame([("a", 1.0)], "event_type string, value double").withColumn("ts", F.current_timestamp())
    assert scoring.windowed_counts(events).count() == 1
