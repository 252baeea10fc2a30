"""Registered queries without SQL do the whole job: whole texts, whole pools, the operators' own iterations."""

import numpy as np
import pytest

from cohortlens.functions.hashing import counter_uniform_np
from cohortlens.operators import learning
from cohortlens.plans import cohort_queries, queries

TEXTS = {1: "GATTACA" * 10, 2: "GATTACA" * 4 + "CCCC", 3: "acgt! " * 2, 4: "ac", 5: "xyz", 6: None, 7: "GGUUAACC" * 6}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1), (7, 0), (7, 1)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    r = np.random.default_rng(4)
    vectors = [(i, i % 3, [float(x) for x in r.normal(size=20) + (i % 3 == 0)]) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


def letters(text):
    return "".join(c for c in (text or "").upper().replace("T", "U") if c in "ACGU")


def test_pool_has_whole_texts(spark, tables):
    got = {r["name"]: (r["sequence"], r["family"], r["positive"]) for r in queries.curated(spark, tables).collect()}
    assert {k: got[f"d{k}"][0] for k in (1, 2, 3, 7)} == {k: letters(TEXTS[k]) for k in (1, 2, 3, 7)}
    assert got["d1"][2] == 1 and got["d2"][2] == 0 and got["d7"] == (letters(TEXTS[7]), letters(TEXTS[7])[1:8], 1)


def test_random_ranking_sees_whole_texts(spark, tables):
    got = {r["entity"]: r["percentile"] for r in queries._midranked(spark, tables).collect()}
    share = {k: round(sum(c in "GC" for c in s) / max(1, len(s)), 6) for k, s in ((k, letters(t)) for k, t in TEXTS.items())}
    family = {k: letters(t)[1:8] for k, t in TEXTS.items()}
    for k in (1, 7):
        pool = [b for b in TEXTS if b not in (1, 7) and family[b] != family[k]]
        worse = sum((share[b] > share[k]) + (share[b] == share[k]) / 2 for b in pool)
        assert abs(got[k] - (1 - worse / len(pool))) < 1e-9


def test_gradient_fit_has_all_components_and_epochs(spark, tables):
    rows = spark.read.parquet(f"{tables}/embeddings.parquet").orderBy("vec_id").collect()
    x, y = np.array([r["embedding"] for r in rows]), np.array([float(r["label"] == 0) for r in rows])
    w, b = learning.gradient_logistic((x - x.mean(0)) / x.std(0, ddof=1), y, epochs=1800)
    got = {r["feature"]: r for r in queries.gd_logistic(spark, tables).collect()}
    assert set(got) == {f"f{i}" for i in range(20)}
    assert all(abs(got[f"f{i}"]["weight"] - w[i]) < 2e-6 and abs(got[f"f{i}"]["bias"] - b) < 2e-6 for i in range(20))


def test_every_unlabelled_sequence_is_ranked_by_the_whole_ensemble(spark, tables):
    got = queries.ensemble_ranking(spark, tables).collect()
    assert {r["name"] for r in got} == {"d2", "d3", "d4"} and sorted(r["rank"] for r in got) == [1, 2, 3]
    entries = queries.curated(spark, tables).toPandas().sort_values("name").reset_index(drop=True)
    positives, rest = entries[entries["positive"] == 1], entries[entries["positive"] == 0]
    e = learning.Ensemble(positives, rest, learning.CONFIGS[0], 20, 800, 420, "final")
    want = dict(zip(rest["name"], e.consensus(rest["sequence"]), strict=True))
    assert all(abs(r["score"] - want[r["name"]]) < 2e-6 and r["oob_models"] == 0 and r["fallback"] for r in got)


def test_nested_validation_has_all_positives_and_representations(spark, tables):
    got = queries.nested_validation(spark, tables).collect()
    count = {}
    for r in got:
        count[r["scorer"]] = count.get(r["scorer"], 0) + r["n"]
    scorers = {"ensemble", "seed", "centroid", "composition", "hash"} | {f"ablation:{b}" for b in ("core", "composition", "positional", "terminals", "full")}
    assert count == dict.fromkeys(scorers, 2)


@pytest.mark.parametrize("sizes", [(2, 3, 4), (2, 3, 4, 5), (2, 3, 4, 5, 6, 7)])
def test_dense_features_agree(sizes):
    r = np.random.default_rng(6)
    texts = ["", "A", "GU", "ACG", *("".join(r.choice(list("ACGU"), n)) for n in (4, 7, 8, 22, 300))]
    for blocks in ("core", "composition", "positional", "terminals", "full"):
        columns = learning.feature_columns(sizes, blocks)
        x, mass = learning.dense_features(texts, sizes, blocks)
        for s, row, m in zip(texts, x, mass, strict=True):
            want = learning.sequence_features(s, sizes, blocks)
            assert abs(want.pop("seed:" + s[1:8]) - m) < 1e-12
            assert set(want) <= set(columns) and all(abs(row[i] - want.get(f, 0.0)) < 1e-12 for f, i in columns.items())


def share_gc(s):
    return sum(c in "GC" for c in s) / max(1, len(s))


def cosine(a, b):
    norm = sum(x * x for x in a.values()) ** 0.5 * sum(x * x for x in b.values()) ** 0.5
    return sum(x * b.get(f, 0.0) for f, x in a.items()) / norm if norm else 0.0


def validated(entries, configs, outer, inner, bags, size, epochs, inner_size, inner_epochs):
    """Nested validation in one process: {(fold, scorer, name): percentile} and the chosen configurations."""
    positives, background = entries[entries["positive"] == 1], entries[entries["positive"] == 0]
    names, out, chosen = background["name"], {}, {}

    def dealt(families, k, salt):
        ordered = sorted(set(families), key=lambda f: (learning.fnv1a_py(f"{salt}|{f}"), f))
        return {f: i % min(k, len(ordered)) for i, f in enumerate(ordered)}

    def ranked(held, mine, theirs):
        for n, f, s in zip(held["name"], held["family"], np.round(mine, 10), strict=True):
            t = np.round(theirs, 10)[(background["family"] != f).to_numpy()]
            yield n, f, 1 - ((t > s).sum() + (t == s).sum() / 2) / max(1, len(t))

    def by_fit(train, held, *options):
        e = learning.Ensemble(train, background, *options)
        return list(ranked(held, e.consensus(held["sequence"]), e.consensus(background["sequence"])))

    folds = dealt(positives["family"], outer, "outer")
    for fold in sorted(set(folds.values())):
        at = positives["family"].map(folds)
        train, held = positives[at != fold], positives[at == fold]
        inside = train["family"].map(dealt(train["family"], inner, f"inner-{fold + 1}"))
        best = []
        for c in configs:
            by = {}
            for k in sorted(set(inside)):
                for _, f, p in by_fit(train[inside != k], train[inside == k], c, 1, inner_size, inner_epochs, f"inner-{fold + 1}-{k}-{c[0]}"):
                    by.setdefault(f, []).append(p)
            means = np.array([np.mean(p) for p in by.values()])
            best.append((-means.mean(), -(means >= 0.9).mean(), c[0], c))
        c = min(best)[3]
        chosen[fold + 1] = (c[0], -min(best)[0])
        out |= {(fold + 1, "ensemble", n): p for n, _, p in by_fit(train, held, c, bags, size, epochs, f"outer-{fold + 1}-{c[0]}")}
        for a in learning.ABLATIONS:
            out |= {(fold + 1, f"ablation:{a[2]}", n): p for n, _, p in by_fit(train, held, a, bags, size, epochs, f"outer-feature-ablation-{fold + 1}")}
        share = lambda a, b: sum(x == y for x, y in zip(a, b)) / max(len(a), len(b), 1)
        near = lambda df: [max(share(s[1:8], t[1:8]) for t in train["sequence"]) for s in df["sequence"]]
        hashed = lambda df: [learning.fnv1a_py(f"random-baseline|{fold + 1}|{n}") / 0xFFFFFFFF for n in df["name"]]  # noqa: E731, B023
        vectors = [learning.sequence_kmers(s, c[1]) for s in train["sequence"]]
        center = {f: sum(v.get(f, 0.0) for v in vectors) / len(vectors) for v in vectors for f in v}
        length, gc = train["sequence"].str.len().mean(), np.mean([share_gc(s) for s in train["sequence"]])
        composed = lambda df: [1 - min(1, (abs(len(s) - length) / max(1, length) + abs(share_gc(s) - gc)) / 2) for s in df["sequence"]]  # noqa: E731, B023
        central = lambda df: [cosine(learning.sequence_kmers(s, c[1]), center) for s in df["sequence"]]  # noqa: E731, B023
        for name, f in (("seed", near), ("hash", hashed), ("centroid", central), ("composition", composed)):
            out |= {(fold + 1, name, n): p for n, _, p in ranked(held, f(held), f(background))}
    assert len(names) == len(set(names))
    return out, chosen


@pytest.mark.parametrize("scores", [1 << 20, 9])
def test_nested_validation_agrees_with_one_process(spark, scores, monkeypatch):
    monkeypatch.setattr(learning, "RANGE_SCORES", scores)  # small: each fit's scores are in several ranges
    monkeypatch.setattr(learning, "PACKED_ROWS", min(scores, 8192))
    r = np.random.default_rng(8)
    rows = []
    for i in range(60):
        s = "".join(r.choice(list("ACGU"), int(r.integers(9, 60))))
        if i < 18:
            s = s[:1] + ("GAGGUAG", "CCCUGAG", "AAAGUGC", "UUAGGCA", "GGCAUUA", "ACACGUU")[i % 6] + s[8:]
        rows.append((f"m{i:03d}", s, s[1:8], int(i < 18), 1.0 + i % 2))
    entries = spark.createDataFrame(rows, "name string, sequence string, family string, positive int, evidence double")
    options = {"outer": 3, "inner": 2, "bags": 2, "size": 25, "epochs": 15, "inner_size": 15, "inner_epochs": 10}
    assert len({c[0] for c in learning.CONFIGS}) == 8 and any(c[4] > 0 for c in learning.CONFIGS)
    want, chosen = validated(entries.toPandas(), learning.CONFIGS, **options)
    frame = learning.nested_validation(entries, **options)
    frame.cache()
    got = {(x["fold"], x["scorer"], x["name"]): x for x in frame.collect()}
    assert all(abs(got[k]["percentile"] - p) < 1e-9 for k, p in want.items()) and len(got) == 18 * 10
    assert all((x["config"], round(x["inner_score"], 9)) == (chosen[k[0]][0], round(chosen[k[0]][1], 9)) for k, x in got.items() if k[1] == "ensemble")
    summary = {x["blocks"]: x for x in learning.ablation_summary(frame, 50, 100).collect()}
    assert set(summary) == {"core", "composition", "positional", "terminals", "full"} and summary["core"]["fdr"] is None
    assert all(x["families"] == 6 and x["mean_low"] <= x["mean_percentile"] <= x["mean_high"] for x in summary.values())
    p = sorted(x["p_value"] for x in summary.values() if x["p_value"] is not None)
    assert len(p) == 4 and abs(max(x["fdr"] for x in summary.values() if x["fdr"] is not None) - p[-1]) < 1e-9


def test_random_ranking_has_all_iterations(spark, tables):
    got = queries.random_ranking(spark, tables).first()
    for p in (got["p_mean"], got["p_recall"]):
        assert abs(p * 10_001 - round(p * 10_001)) < 1e-6 and 1 <= round(p * 10_001) <= 10_001
    fam = queries._midranked(spark, tables).groupBy("family").agg({"percentile": "avg", "*": "count"}).orderBy("family").collect()
    assert all(r["count(1)"] == 1 for r in fam)
    u = counter_uniform_np(0x50A17E, 10_000 * len(fam)).reshape(10_000, len(fam)).mean(axis=1)
    assert round(got["p_mean"] * 10_001) - 1 == (u >= np.mean([r["avg(percentile)"] for r in fam])).sum()


def test_ranks_of_tied_scores():
    """Few distinct scores, so that ranges, packs and families share ties."""
    r = np.random.default_rng(3)
    s, f, c = r.integers(0, 6, 300) / 4, r.integers(-1, 5, 300).astype(np.int32), r.integers(1, 4, 300)
    held, own = r.integers(-1, 8, 40) / 4, r.integers(0, 6, 40).astype(np.int32)
    got = learning._counted(s, f, c, held, own)
    for i, (h, o) in enumerate(zip(held, own, strict=True)):
        assert got[:, i].tolist() == [c[s > h].sum(), c[s == h].sum(), c[(s > h) & (f == o)].sum(), c[(s == h) & (f == o)].sum()]


def test_out_of_bag_ranking_agrees_with_one_process(spark):
    """Bags leave most entries out, so the number of models, the scores, the spread and the contributions differ by entry."""
    r = np.random.default_rng(9)
    rows = []
    for i in range(70):
        s = "".join(r.choice(list("ACGU"), int(r.integers(9, 40))))
        if i < 15:
            s = s[:1] + ("GAGGUAG", "CCCUGAG", "AAAGUGC")[i % 3] + s[8:]
        rows.append((f"m{i:03d}", s, s[1:8], int(i < 15), 1.0 + i % 2))
    entries = spark.createDataFrame(rows, "name string, sequence string, family string, positive int, evidence double")
    got = {x["name"]: x for x in learning.rank_candidates(entries, learning.CONFIGS[4], 4, 30, 25, "s").collect()}
    frame = entries.toPandas()
    positives, rest = frame[frame["positive"] == 1], frame[frame["positive"] == 0].reset_index(drop=True)
    e = learning.Ensemble(positives, rest, learning.CONFIGS[4], 4, 30, 25, "s")
    x = e.matrix(rest["sequence"])
    logits = x @ np.array(e.weights).T + np.array(e.biases)
    percentiles = {n: [] for n in rest["name"]}
    for b in range(4):
        eligible = sorted((logits[i, b], n) for i, n in enumerate(rest["name"]) if n not in e.members[b])
        for place, (_, n) in enumerate(eligible):
            percentiles[n].append(place / (len(eligible) - 1))
    assert len({x["oob_models"] for x in got.values()}) > 2 and any(x["fallback"] for x in got.values())
    for i, n in enumerate(rest["name"]):
        out = [b for b in range(4) if n not in e.members[b]]
        use = out or list(range(4))
        assert got[n]["oob_models"] == len(out) and got[n]["fallback"] == (not out)
        assert abs(got[n]["score"] - logits[i, use].mean()) < 1e-9
        if out:
            assert abs(got[n]["median"] - np.quantile(percentiles[n], 0.5)) < 1e-9 and abs(got[n]["q25"] - np.quantile(percentiles[n], 0.25)) < 1e-9
            assert abs(got[n]["top_10"] - np.mean([p >= 0.9 for p in percentiles[n]])) < 1e-9
        share = x[i] * np.mean([e.weights[b] for b in use], axis=0)
        best = [e.vocabulary[j] for j in np.argsort(-share, kind="stable")[:10] if share[j] > 0]
        assert got[n]["features"] == best


def whole_ablation(entries, configs, outer, bags, size, epochs):
    """The ablation in one process, fitted on all positives of the other folds: {(fold, scorer, name): percentile}."""
    positives, background = entries[entries["positive"] == 1], entries[entries["positive"] == 0]
    ordered = sorted(set(positives["family"]), key=lambda f: (learning.fnv1a_py(f"outer|{f}"), f))
    at, out = positives["family"].map({f: i % outer for i, f in enumerate(ordered)}), {}
    for fold in range(outer):
        train, held = positives[at != fold], positives[at == fold]
        for c in configs:
            e = learning.Ensemble(train, background, c, bags, size, epochs, f"outer-feature-ablation-{fold + 1}")
            theirs = np.round(e.consensus(background["sequence"]), 10)
            for n, f, s in zip(held["name"], held["family"], np.round(e.consensus(held["sequence"]), 10), strict=True):
                t = theirs[(background["family"] != f).to_numpy()]
                out[fold + 1, f"ablation:{c[2]}", n] = 1 - ((t > s).sum() + (t == s).sum() / 2) / max(1, len(t))
    return out


@pytest.mark.parametrize("held_bytes", [learning.FOLD_BYTES, 0])
def test_ablation_agrees_with_one_process(spark, held_bytes, monkeypatch):
    """Held by a task for each fold, and as packed rows with a job for each epoch; some sequences count over 255 of a k-mer, some have no seed of seven letters."""
    monkeypatch.setattr(learning, "FIT_ROWS", 16)
    r = np.random.default_rng(11)
    rows = []
    for i in range(90):
        s = "".join(r.choice(list("ACGU"), int(r.integers(9, 60))))
        s = s[:1] + ("GAGGUAG", "CCCUGAG", "AAAGUGC", "UUAGGCA")[i % 4] + s[8:] if i < 20 else {88: "GA", 89: s + "AC" * 700, 30: s + "U" * 300}.get(i, s)
        rows.append((f"m{i:03d}", s, s[1:8], int(i < 40 or i > 87), 1.0 + 0.137 * (i % 5)))
    entries = spark.createDataFrame(rows, "name string, sequence string, family string, positive int, evidence double")
    options = {"outer": 3, "bags": 2, "size": 25, "epochs": 15}
    want = whole_ablation(entries.toPandas(), learning.ABLATIONS, **options)
    got = {(x["fold"], x["scorer"], x["name"]): x["percentile"] for x in learning.ablation_validation(entries, held_bytes=held_bytes, **options).collect()}
    assert got.keys() == want.keys() and len(got) == 42 * 5 and all(abs(got[k] - p) < 1e-9 for k, p in want.items())


def test_ablation_learns_from_every_positive(spark, tmp_path):
    """Over 500 positives in every fit."""
    r = np.random.default_rng(12)
    texts = ["".join(r.choice(list("ACGT"), int(r.integers(12, 40)), p=[0.3, 0.2, 0.2, 0.3] if i < 700 else [0.25] * 4)) for i in range(780)]
    d = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 700)) for i in range(780)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    got = {x["blocks"]: x for x in cohort_queries.ablation_comparison(spark, d).collect()}
    entries = queries.curated(spark, d).toPandas()
    assert (entries["positive"] == 1).sum() * 4 // 5 > 500
    want = whole_ablation(entries, learning.ABLATIONS[:1], 5, 3, 650, 150)
    by = entries.set_index("name")["family"]
    families = {}
    for (_, _, name), p in want.items():
        families.setdefault(by[name], []).append(p)
    assert got["core"]["families"] == len(families) and abs(got["core"]["mean_percentile"] - np.mean([np.mean(p) for p in families.values()])) < 2e-6
    assert set(got) == {c[2] for c in learning.ABLATIONS}
