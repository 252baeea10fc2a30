import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, prose, tmp_path):
    passage = prose(777, 70)
    rows = []
    for i in range(120):
        t = prose(i, 80)
        if i % 6 == 0:
            t += " vilscum krazzle mogwort"
        if i in (31, 32):
            t = t[:200] + passage + t[200:]
        rows.append((i, t))
    rows += [(500, rows[1][1]), (501, rows[1][1] + " more"), (502, None), (503, ""), (1, rows[1][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "keep") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, toxic_score string")
    sf = str(tmp_path)
    spark.createDataFrame([(i, int(i % 6 != 1), int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "repeated passages", "mixing", "packing"]
    (_, toxic), (_, near), (_, cut), (_, mix), (_, packed) = corpus_pipeline.STAGES
    a = toxic(spark, docs, sf)
    ids = {r["doc_id"] for r in a.collect()}
    assert a.columns == docs.columns and sum(i < 120 and i % 6 == 0 for i in ids) <= 1 and sum(i < 120 and i % 6 != 0 for i in ids) == 100
    assert {r["toxic_score"] for r in a.collect()} == {"keep"}
    b = near(spark, a, sf)
    kept = [r["doc_id"] for r in b.collect()]
    assert b.columns == docs.columns and kept.count(1) == 1 and not {500, 501} & set(kept) and {502, 503} <= set(kept)
    c = cut(spark, b, sf)
    texts = {r["doc_id"]: r for r in c.collect()}
    assert passage[:150] not in texts[31]["text"] and texts[31]["n_chars"] == len(texts[31]["text"]) and texts[2]["text"] == rows[2][1] and len(texts) == len(kept)
    d = mix(spark, c, sf)
    assert d.columns == docs.columns and d.count() > 0
    assert packed(spark, d, sf).where("length > 0").count() >= d.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_run(spark, prose, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(i, prose(i, 40), "en", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_rows_that_share_an_id_are_judged_apart(spark, prose, tmp_path):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(3, a), (7, a), (7, b), (9, b + " x1"), (9, b + " x1 x2"), (5, c), (5, c + " y"), (5, c + " z"), (None, a), (11, None), (11, ""), (12, None), (3, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()), key=str)
    of_c = [x for x in left if x[0] == 5]
    assert len(of_c) == 1 and of_c[0][1].startswith(c)
    assert [x for x in left if x[0] != 5] == sorted([(3, a), (7, b), (None, a), (11, None), (11, ""), (12, None)], key=str)


def test_only_wholly_equal_rows_are_repeats(spark, prose, tmp_path):
    t, n, w = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, t, "x"), (1, t, "y"), (1, t, "y"), (None, n, "p"), (None, n, "q"), (None, n, "q"), (2, w, "z"), (3, w, "z")]
    docs = spark.createDataFrame([(i, s, "en", o, 1) for i, s, o in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()), key=str)
    assert left == sorted([(1, t, "x"), (1, t, "y"), (None, n, "p"), (None, n, "q"), (None, n, "q"), (2, w, "z")], key=str)


def jaccard_clusters(rows):
    """Components of documents (id, text) of a word-5-gram similarity of 0.8, all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_pipeline_equals_a_plain_version(spark, prose, tmp_path):
    """300 rows: what stays, what is cut and what is packed, by brute force; toxicity and rates are taken from their stages."""
    import collections

    from tokenizers import Tokenizer

    from cohortlens.llm.queries import byte_bpe

    passage, rows = prose(777, 70), []
    for i in range(240):
        t = prose(i, 30 + i % 50)
        if i % 6 == 0:
            t += " vilscum krazzle mogwort"
        rows.append((i, t[:90] + passage + t[90:] if i % 40 == 1 else t))
    rows += [(240 + i, rows[i * 3][1] + (" end" if i % 2 else "")) for i in range(60)]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    kept = sorted(r for r in rows if r[0] in clean)
    least = {}
    for (i, t), g in zip(kept, jaccard_clusters(kept)):
        least.setdefault(g, (i, t))
    kept = sorted(least.values())
    raw = [t.encode() for _, t in kept]
    seen = collections.Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    cut = {}
    for (i, _), b in zip(kept, raw):
        gone = {q for p in range(len(b) - 199) if seen[b[p : p + 200]] > 1 for q in range(p, p + 200)}
        cut[i] = bytes(c for q, c in enumerate(b) if q not in gone).decode()
    assert any(len(cut[i]) < len(t) for i, t in kept)
    plain = Tokenizer.from_file(byte_bpe())
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_row"]].append(r)
    found = set()
    for pieces in by.values():  # one for each copy of a document
        pieces.sort(key=lambda r: r["start"])
        ids = b"".join(bytes(p["ids"]) for p in pieces)
        found.add(pieces[0]["doc_id"])
        assert list(memoryview(ids).cast("I")) == [*plain.encode(cut[pieces[0]["doc_id"]], add_special_tokens=False).ids, 1]
    assert found <= set(cut) and len(found) > 0.5 * len(cut)
