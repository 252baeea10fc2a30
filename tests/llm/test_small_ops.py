import hashlib
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import common, langid, linear_text, media, mixing, mtree, toxicity, url_rules, warc
from cohortlens.llm.queries import RULES


# --- URL rules ---


def judge(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fit = [(len(h) + len(p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else None
    return host, path, best[3] if best else None, best[4] if best else "allow"


URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/x?y=/z", "http://a.b.example.com/en/#t", "http://example.com", "http://example.com?x=/en/", "http://net/es/", "http://x.net/es", "http://x.net/fr/a",
    "no scheme", "://", None, "", "http://xcom/", "ftp://com/", "http://é.example.net/es/é", "http://a" + ".b" * 60 + ".com/p", "http://example.com:80/en/", "http://x://example.com/en/",
]


@pytest.mark.parametrize("most", [url_rules.BROADCAST_RULES, 0])
def test_url_rules(spark, most, monkeypatch):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", most)
    rows = [(i, u, "v") for i, u in enumerate(URLS)] + [(1, URLS[1], "v"), (None, URLS[0], "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    extra = [*RULES, ("allow", "example.com", "/en/"), ("block", "", "/"), ("odd", "com", "/x"), ("block", "com", "/pa")]
    got = sorted((tuple(r) for r in url_rules.judge_urls(pages, url_rules.rules_frame(spark, extra)).collect()), key=str)
    known = [r for r in extra if r[1] and r[0] in ("allow", "block")]
    assert got == sorted(((i, *judge(u, known)) for i, u, _ in rows), key=str)
    assert url_rules.judge_urls(pages.limit(0), url_rules.rules_frame(spark, RULES)).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, url_rules.rules_frame(spark, RULES).limit(0), "block").collect()} == {"block"}


def test_one_very_long_host(spark):
    """A host of 250,000 labels costs no more expressions than a short one."""
    hosts = {1: "a." * 250_000 + "example.com", 2: "." * 300_000 + "net", 3: "com" + "." * 100_000, 4: "." * 5 + "EXAMPLE.com"}
    pages = spark.createDataFrame([(i, f"http://{h}/en/x") for i, h in hosts.items()], "page_id long, url string")
    rules = url_rules.rules_frame(spark, [*RULES, ("block", "..com", "/"), ("allow", "..net", "/en/")])
    began = time.time()
    got = {r["page_id"]: (r["host"], r["rule"]) for r in url_rules.judge_urls(pages, rules).collect()}
    assert time.time() - began < 20
    assert got == {i: (h.lower(), {1: "example.com/en/", 2: "..net/en/", 3: None, 4: "example.com/en/"}[i]) for i, h in hosts.items()}


# --- media ---


def test_media_roundtrip(spark, prose):
    texts = ["", None, "a", "x" * 64, "é" * 50, prose(1, 30000), "same", "same"]
    df = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, image binary")
    rows = {r["doc_id"]: r for r in media.image_features(media.store_images(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert tuple(rows[6])[1:] == tuple(rows[7])[1:] and rows[0]["feature"] == rows[1]["feature"] and len(rows[5]["feature"]) == 16
    assert media.image_features(media.store_images(df.limit(0))).count() == 0


def reference_filter(x, kind):
    h, w = x.shape
    out = np.zeros((h, w + 1), np.uint8)
    out[:, 0] = kind
    for y in range(h):
        for i in range(w):
            a = int(x[y, i - 1]) if i else 0
            b = int(x[y - 1, i]) if y else 0
            c = int(x[y - 1, i - 1]) if i and y else 0
            guess = (0, a, b, (a + b) // 2, media._paeth(a, b, c))[kind]
            out[y, i + 1] = (int(x[y, i]) - guess) % 256
    return out


@pytest.mark.parametrize("kind", range(5))
def test_all_row_filters_are_undone(kind):
    x = np.random.default_rng(kind).integers(0, 256, (9, 7), dtype=np.uint8)
    mixed = reference_filter(x, kind)
    assert (media.unfilter(mixed) == x).all()
    other = reference_filter(x, (kind + 1) % 5)
    mixed[4:] = other[4:]
    assert (media.unfilter(mixed) == x).all()


def test_broken_images_are_found():
    good = media.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    assert (media.decode_png(good) == np.arange(128).reshape(2, 64)).all()
    bad = bytearray(good)
    bad[45] ^= 1
    for data in (bytes(bad), good[:-6], b"x" + good[1:], good[:8] + struct.pack(">I", 9999) + good[12:]):
        with pytest.raises(media.PngError):
            media.decode_png(data)
    tall = np.random.default_rng(0).integers(0, 256, (media.STRIP + 7, 64), dtype=np.uint8)
    k = np.arange(8)[:, None]
    full = np.cos(np.pi * (2 * np.arange(len(tall))[None] + 1) * k / (2 * len(tall))) * np.sqrt(2 / len(tall))
    full[0] /= np.sqrt(2)
    low = (full @ tall @ media._cosines(64).T).round(6).ravel()
    assert media.dct_hash(tall) == np.packbits(low > np.median(low[1:])).tobytes().hex()


# --- WARC ---


def test_warc_roundtrip(spark, prose):
    big = prose(1, 400)
    rows = [(1, "http://a/\r\nx", big), (5, None, big), (9, "http://b", big), (2, "http://c", "small"), (3, "http://c", "small"), (4, "http://d", None), (6, "http://e", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (9, "http://b", big), (None, "http://n", big)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, payload_bytes int")
    got = sorted((tuple(r) for r in warc.roundtrip(df).collect()), key=str)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        origin = 9 if h == big else None
        revisit = origin is not None and p != origin
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", origin if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.roundtrip(df.limit(0)).count() == 0


def test_archives_are_closed_by_bytes(spark, prose, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "MEMBER_BYTES", 5000)
    path = common.shared_dir(spark)
    rows = [(i, f"http://a/{i}", prose(i, 500 if i % 7 else 4000)) for i in range(60)] + [(1, "http://other", prose(1, 500)), (None, "http://null", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    warc.write_warc(df, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    assert len(files) > 3 and all(20_000 * 0.1 < f["length"] < 60_000 for f in files)
    for f in files:
        plain = gzip.decompress(bytes(f["content"]))  # any reader of gzip opens it
        assert [h["warc-record-id"] for h, _ in warc.parse_warc(plain)] == [h["warc-record-id"] for h, _ in warc.parse_warc(bytes(f["content"]))]
    got = warc.assemble(warc.read_warc(spark, path)).collect()
    assert {(r["metadata"]["page_id"], r["capture"]["target_uri"]) for r in got} == {(i, u) for i, u, _ in rows} and len(got) == 62
    assert {bytes(r["capture"]["payload"]).decode() for r in got if r["capture"]["record_type"] == "response"} == {t for _, _, t in rows}


def test_transactions_are_nested(spark):
    path = common.shared_dir(spark)
    df = spark.createDataFrame([(1, "http://a/x", "é" * 10), (2, "http://b", "é" * 10)], "page_id long, url string, html string")
    warc.write_warc(df, path, least_bytes=1)
    got = {r["metadata"]["page_id"]: r for r in warc.assemble(warc.read_warc(spark, path)).collect()}
    assert got[2]["capture"]["record_type"] == "response" and bytes(got[2]["capture"]["payload"]) == ("é" * 10).encode()
    assert got[1]["capture"]["record_type"] == "revisit" and got[1]["capture"]["refers_to"] == got[2]["capture"]["record_id"]
    assert all(r["request"]["concurrent_to"] == r["capture"]["record_id"] == r["capture_id"] for r in got.values())


def test_warc_parser_is_strict():
    ok = warc._record("metadata", "<urn:x>", [], b"a\r\n\r\nb") + b"\r\n\r\n"
    assert [b for _, b in warc.parse_warc(ok + ok)] == [b"a\r\n\r\nb"] * 2
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"junk"))
    with pytest.raises(ValueError):
        list(warc.parse_warc(ok[:-6]))


# --- exact top-k ---


def brute_top(vectors, queries, k):
    out = []
    for q, x in queries.items():
        s = sorted(((-int(np.dot(x, y)), i) for i, y in vectors.items() if i != q and len(y) == len(x)))[:k]
        out += [(q, r, i, -v) for r, (v, i) in enumerate(s, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(4)
    centers = r.normal(size=(5, 8)) * 300
    vectors = {i: (centers[i % 5] + r.normal(size=8) * 40).astype(int) for i in range(900)}
    vectors |= {i: np.array([7] * 8) for i in range(900, 1000)}  # many copies of one vector
    vectors |= {2000: np.zeros(8, int), 2001: np.array([1, 2, 3]), 2002: np.array([4, 5, 6])}
    rows = [(i, v.tolist(), 1) for i, v in vectors.items()] + [(5, vectors[5].tolist(), 1), (None, [1] * 8, 1), (3000, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, score int")
    queries = {i: v for i, v in vectors.items() if i % 50 == 0 or i in (2001, 950)}
    asked = df.where("vec_id % 50 = 0 or vec_id in (2001, 950)")
    for size in (8192, 150):
        tally = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        got = sorted(tuple(x) for x in mtree.top_k(df, asked, 10, size, tally).collect())
        assert got == brute_top(vectors, queries, 10)
        assert 0 < tally[0].value < 0.5 * tally[1].value  # of all pairs
    assert mtree.top_k(df.limit(0), asked, 10).count() == 0 and mtree.top_k(df, asked.limit(0), 10).count() == 0


@pytest.mark.parametrize("size", [8192, 20])
def test_an_id_of_two_vectors_counts_once(spark, size):
    r = np.random.default_rng(6)
    rows = [(i, r.integers(-500, 500, 4).tolist()) for i in range(200)] + [(500, [900, 0, 0, 0]), (500, [0, 800, 0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    asked = spark.createDataFrame([(900, [10, 10, 0, 0]), (901, [10, 0, 0, 0])], "vec_id long, v array<long>")
    vectors = {i: np.array(min(w for j, w in rows if j == i)) for i, _ in rows}
    got = sorted(tuple(x) for x in mtree.top_k(df, asked, 10, size).collect())
    assert got == brute_top(vectors, {900: np.array([10, 10, 0, 0]), 901: np.array([10, 0, 0, 0])}, 10)


def test_bounds_avoid_work():
    r = np.random.default_rng(5)
    x = (r.normal(size=(40, 16)) * 1000)[r.integers(0, 40, 3000)] + r.normal(size=(3000, 16)) * 5
    x = x.astype(np.int64)
    pages = {p["node"]: p | {"radius": np.asarray(p["radius"])} for p in mtree.build_pages(np.arange(3000), x)}
    s = mtree.Searcher(pages, float(np.linalg.norm(x, axis=1).max()))
    for q in range(0, 3000, 300):
        want = sorted((-int(x[q] @ x[i]), i) for i in range(3000) if i != q)[:10]
        assert s.search(x[q], q, 10) == [(-v, i) for v, i in want]
    assert s.computed < 0.3 * 10 * 3000


def test_quantize(spark):
    df = spark.createDataFrame([([0.5, -0.0001],), ([float("nan")],), ([None, 1.0],), (None,), ([float("inf")],), ([],)], "e array<float>")
    assert [r[0] for r in df.select(mtree.quantize(F.col("e"))).collect()] == [[512, -1], None, None, None, None, []]


# --- classifiers ---


def labelled(prose, n=240):
    rows = []
    for i in range(n):
        t = prose(i, 60).split()
        bad = i % 4 == 0
        if bad:
            for k in range(3):
                t[(i + k * 17) % 60] = ("vilscum", "krazzle", "mogwort")[k]
        rows.append((i, " ".join(t), int(bad)))
    return rows


def test_toxicity(spark, prose):
    rows = labelled(prose)
    docs = spark.createDataFrame([(i, t, "q") for i, t, _ in rows] + [(900, None, "q"), (901, "", "q"), (902, "KRAZZLE! vilscum mogwort " + prose(5, 30), "q"), (902, "x", "q")], "doc_id long, text string, toxic_score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(1, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    by = {r["doc_id"]: r["toxic_score"] for r in got if r["doc_id"] < 900}
    held = [(by[i] >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0]
    assert np.mean(held) > 0.95 and len(got) == len(rows) + 4 and all(0 <= r["toxic_score"] <= 1 for r in got)
    special = [r["toxic_score"] for r in got if r["doc_id"] >= 900]
    assert special[0] == special[1] < 0.5 and max(special) > 0.5
    assert toxicity.fit_toxicity(docs, labels.limit(0)) is None
    assert {r["toxic_score"] for r in toxicity.score_toxicity(docs.limit(3), None).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_language_id(spark):
    import random

    r = random.Random(1)
    sounds = {"aa": "ka ke ki ko ta te".split(), "bb": "schl ung ein ch tz".split(), "cc": "ção lh nh ar em".split()}
    rows = [(i, " ".join("".join(r.choice(sounds[lang]) for _ in range(3)) for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !?", "aa"), (902, "", None), (903, "k", None)], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    profiles = langid.fit_profiles(docs.where("doc_id % 4 <> 2"))
    assert profiles.languages == ("aa", "bb", "cc")
    got = {x["doc_id"]: x for x in langid.predict_language(docs, profiles).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows) and all(0 <= x["lang_score"] <= 1 for x in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] != "und"
    assert langid.fit_profiles(docs.limit(0)) is None
    assert langid.predict_language(docs.limit(2), None).first()["lang_pred"] == "und"


def test_mixing(spark, prose):
    rows = [(i, (prose(i, 30).upper() + "!!") if i % 5 == 0 else prose(i, 30), int(i % 5 != 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (3, rows[3][1], 1.0)], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, quality int")
    model = mixing.fit_domains(docs, labels, "quality")
    got = mixing.mix(docs, model, {0: 0.5, 1: 0.5}, ["doc_id"]).collect()
    p, w, rate = np.array([r["posteriors"] for r in got]), np.array([r["tokens"] for r in got]), np.array([r["rate"] for r in got])
    reached = (p * (w * rate)[:, None]).sum(0) / w.sum()
    assert np.allclose(reached, [0.5, 0.5], atol=2e-4) and (rate >= 0).all() and len(got) == 303
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in got) and {r["tokens"] for r in got if r["doc_id"] >= 900} == {0}
    # the least-squares solution nearest to 1, by brute force in the dual
    share = w / w.sum()
    gram = (p * share[:, None]).T @ p
    dual = np.linalg.solve(gram, np.array([0.5, 0.5]) - (p * share[:, None]).sum(0))
    want = 1 + p @ dual
    assert (want > 0).all()  # so the bound at 0 is idle and the closed form is the answer
    assert np.abs(want - rate).max() < 5e-3
    assert mixing.word_counts(pa.RecordBatch.from_arrays([pa.array([" a  b\t", None, "", "x" * 50])], ["t"]), "t").tolist() == [2, 0, 0, 1]
    assert mixing.mix(docs, None, {0: 1.0}, ["doc_id"]).where("rate = 1").count() == 303
    assert mixing.mix(docs.limit(0), model, {0: 1.0}, ["doc_id"]).count() == 0


def test_out_of_reach_targets_end(spark):
    scored = spark.createDataFrame([(10, [0.4, 0.6]), (20, [0.5, 0.5])], "tokens long, posteriors array<double>")
    steps, reached = mixing.fit_rates(scored, [0.0, 1.0])
    rates = [r[0] for r in scored.select(mixing.rate_of(F.col("posteriors"), steps)).collect()]
    assert len(steps) <= mixing.STEPS and rates[1] == 0 and rates[0] > 1 and 0.55 < reached[1] <= 0.6 + 1e-9


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, Text string")
    assert common.only(df, "doc_id", "text").first()["text"] == "a"
    with pytest.raises(ValueError):
        common.only(df, "nothing")
    assert linear_text.labelled_sample(df, spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, label int")).first()["label"] == 1


def test_tables_are_released(spark):
    mark = common.written()
    a, b = common.materialize(spark.range(3)), common.materialize(spark.range(4))
    common.release(spark, mark, keep_last=True)
    assert b.count() == 4 and common.written() == mark + 1
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(a.inputFiles()[0]).count()


# --- classifiers against plain versions ---


def texts_batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])


ODD = ["", None, "a", "ab", "Straße ÉTÉ 漢字 x", "ŁÓDŹ! 12 łódź", "q" * 70, " . ", "one two three one two"]


def plain_ngrams(text, sizes):
    folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    return {folded[i : i + n] for n in sizes for i in range(len(folded) - n + 1)}


@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_features_are_the_distinct_ngrams(piece, prose, monkeypatch):
    from cohortlens.llm import ngrams

    texts = [*ODD, prose(1, 30), prose(2, 8) + " é漢" * 9]
    monkeypatch.setattr(ngrams, "SLICE", piece)
    number = {}
    for t in texts:  # each text alone: long ones come in pieces
        rows, buckets = linear_text.features(texts_batch([t]), "text", (4, 5, 6), 30, True)
        want = plain_ngrams(t, (4, 5, 6))
        assert len(buckets) == len(want) and not rows.any()
        number[t] = set(buckets.tolist())
    rows, buckets = linear_text.features(texts_batch(texts), "text", (4, 5, 6), 30, True)
    assert [set(buckets[rows == i].tolist()) for i in range(len(texts))] == [number[t] for t in texts]


def test_fit_equals_a_plain_version(spark, prose):
    rows = [(t, y) for _, t, y in labelled(prose, 60)] + [("", 0), (None, 1)]
    sample = spark.createDataFrame(rows, "text string, label int")
    model = linear_text.fit(sample, sizes=(4,), bits=22)
    sets = [plain_ngrams(t, (4,)) for t, _ in rows]
    y = np.array([y for _, y in rows])
    grams = sorted(set().union(*sets))
    x = np.array([[g in s for g in grams] for s in sets], float)
    inside, total = x[y == 1].sum(0), x.sum(0)
    ratio = np.log((1 + inside) / (1 + y.sum())) - np.log((1 + total - inside) / (1 + len(y) - y.sum()))
    ratio[(total < max(4, 0.02 * min(y.sum(), len(y) - y.sum()))) | (np.abs(ratio) < 1.5)] = 0
    x, w, b, m1, m2 = x * ratio, np.zeros(len(grams)), np.log(y.mean() / (1 - y.mean())), np.zeros(len(grams) + 1), np.zeros(len(grams) + 1)
    for t in range(1, 81):
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        slope = np.r_[x.T @ g / len(y) + 5e-4 * w, g.mean()]
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.99 * m2 + 0.01 * slope**2
        step = 0.03 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1] * (ratio != 0), b - step[-1]
    want = 1 / (1 + np.exp(-(x @ w + b)))
    got = model.posteriors(texts_batch([t for t, _ in rows]), "text")[:, 1]
    assert np.abs(got - want).max() < 1e-4


def plain_bundle(text):
    s = [c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else None for c in text or ""]
    v = {c: langid.letter_vectors(np.array([ord(c) if c else 0]))[0].astype(int) for c in {*s, None}}
    out = np.zeros(langid.DIMENSIONS)
    for i, c in enumerate(s):
        if c:
            before, after = s[i - 1] if i else None, s[i + 1] if i + 1 < len(s) else None
            out += np.roll(v[before], 2) * np.roll(v[c], 1) * v[after]
    return out


@pytest.mark.parametrize("cells", [1 << 21, 1 << 12])
def test_bundles_equal_a_plain_version(cells, prose, monkeypatch):
    from cohortlens.llm import ngrams

    monkeypatch.setattr(langid, "CELLS", cells)
    texts = [*ODD, *(prose(i, 40) for i in range(4)), *(prose(i, 1) for i in range(300))]
    want = np.array([plain_bundle(t) for t in texts])
    assert (langid.bundles(texts_batch(texts), "text") == want).all()
    monkeypatch.setattr(ngrams, "SLICE", 11)
    for t in texts[:12]:
        assert (langid.bundles(texts_batch([t]), "text")[0] == plain_bundle(t)).all()


def test_more_than_a_thousand_languages(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} x", f"l{i:04d}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit_profiles(docs)
    assert len(profiles.languages) == 1200
    assert langid.predict_language(docs, profiles).where("lang <> lang_pred").count() == 0


def test_short_and_long_texts_stay_small(prose):
    """Many short texts, and one long one, through the kernels, in a process of their own."""
    import os
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from cohortlens.llm import common, langid, linear_text, minhash, mixing, suffix_repeats
from cohortlens.llm.common import slices
words = np.array(["%x" % (i * 2654435761 % 99991) for i in range(5000)])
rng = np.random.default_rng(1)
short = pa.RecordBatch.from_arrays([pa.array(rng.choice(words, 60_000).tolist())], ["text"])
long = pa.RecordBatch.from_arrays([pa.array([" ".join(rng.choice(words, 4_000_000).tolist())])], ["text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for batch in (short, long):
    for part in slices(batch, "text"):
        if sys.argv[1] == "op1":
            sets, at = minhash.shingle_sets(part, "text", 5)
            minhash.signatures(sets, at, 20)
        elif sys.argv[1] == "op5":
            linear_text.features(part, "text", (4, 5, 6), 20, True)
        elif sys.argv[1] == "op6":
            langid.bundles(part, "text")
        elif sys.argv[1] == "op3":
            mixing.word_counts(part, "text")
        else:
            for data, at, begin in suffix_repeats.pieces(part, "text", 200):
                suffix_repeats.segments(data, at, 200, 32)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name, most in (("op1", 250), ("op3", 100), ("op5", 350), ("op6", 200), ("op9", 120)):
        out = subprocess.run([sys.executable, "-c", code, name], cwd=root, env=os.environ | common.WORKER_ENVIRONMENT, capture_output=True, text=True, check=True)
        assert int(out.stdout) < most, (name, out.stdout)
