"""CSV dialects and their line numbers, the CSV sink of streams, the ledger of runs, and the one-class ranking against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import checks, learning, sequences
from cohortlens.plans import ledger, pipelines, reports
from cohortlens.sources import dialects
from cohortlens.streaming import csv_sink


def tokens(line, anywhere):
    """A state machine over the letters of a line."""
    out, cell, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted and c == '"' and line[i + 1 : i + 2] == '"':
            cell, i = cell + '"', i + 1
        elif c == '"' and quoted:
            quoted = False
        elif not quoted and c == ",":
            out.append(cell)
            cell = ""
        elif c == '"' and not quoted and (anywhere or not cell):
            quoted = True
        else:
            cell += c
        i += 1
    return [*out, cell]


def test_cells_equal_a_state_machine(spark):
    r = np.random.default_rng(1)
    lines = ["".join(r.choice(list('",a b'), int(n), p=[0.3, 0.25, 0.25, 0.1, 0.1])) for n in r.integers(0, 14, 600)]
    lines += ["", ",", ",,", '"', '""', '"a""b",c', 'a"b,c"', 'x,"a,', '"a"b"c', '"' + "x" * 50_000 + '",é', "a" * 100_000, '"a""' * 400]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    for dialect in ("start", "anywhere"):
        got = {x["i"]: x["c"] for x in df.select("i", dialects.cells(F.col("line"), dialect).alias("c")).collect()}
        assert all(got[i] == tokens(x, dialect == "anywhere") for i, x in enumerate(lines))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    text = "﻿k,v\r\n" + "".join(f"{i},{'x' * (i % 40)}\r\n" + ("  \r\n" if i % 50 == 0 else "") for i in range(4000))
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "b.csv").write_bytes(b"k,v\n9,z\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    try:
        lines = dialects.numbered_lines(spark, str(tmp_path))
        got = {(r["file"].rsplit("/", 1)[1], r["line_number"]): r["line"] for r in lines.collect()}
        kept = [x.rstrip("\r") for x in text.lstrip("﻿").split("\n") if x.strip()]
        assert got == {("a.csv", n + 1): x for n, x in enumerate(kept)} | {("b.csv", 1): "k,v", ("b.csv", 2): "9,z"}
        table = dialects.read_dialect(spark, str(tmp_path), keep_lines=True)
        assert table.count() == 4001 and table.where("k = '70'").first()["line_number"] == 72  # blank lines are not counted
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_strict_reads_name_the_line(spark, tmp_path):
    (tmp_path / "w.csv").write_text('a,b\n1,2\n\n3,"4,5"\n6,7,8\n9\n')
    (tmp_path / "n.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="w.csv: line 4 has 3 cells, the header 2"):
        dialects.read_dialect(spark, str(tmp_path / "w.csv"), strict=True)
    with pytest.raises(ValueError, match="repeated"):
        dialects.read_dialect(spark, str(tmp_path / "n.csv"), strict=True)
    with pytest.raises(ValueError, match="differ"):
        dialects.read_dialect(spark, str(tmp_path))
    loose = {r["a"]: r["b"] for r in dialects.read_dialect(spark, str(tmp_path / "w.csv")).collect()}
    assert loose == {"1": "2", "3": "4,5", "6": "7", "9": ""}
    assert [r["a"] for r in dialects.read_dialect(spark, str(tmp_path / "n.csv")).collect()] == ["2"]
    (tmp_path / "e.csv").write_text("\n")
    with pytest.raises(ValueError, match="empty"):
        dialects.read_dialect(spark, str(tmp_path / "e.csv"))


def test_a_restarted_stream_writes_no_row_twice(spark, tmp_path, monkeypatch):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    row = lambda i: spark.createDataFrame([(i, f'a "{i}", b')], "k int, v string")
    row(1).write.mode("append").json(source)
    stream = lambda: spark.readStream.schema("k int, v string").option("maxFilesPerTrigger", 1).json(source)
    csv_sink.write_csv_stream(stream(), sink, check).awaitTermination(60)
    row(2).write.mode("append").json(source)
    whole = csv_sink.write_csv

    def torn(df, path, **options):
        whole(df, path, **options)
        raise RuntimeError("lost after the data, before the ledger")

    monkeypatch.setattr(csv_sink, "write_csv", torn)
    with pytest.raises(Exception, match="lost"):
        csv_sink.write_csv_stream(stream(), sink, check).awaitTermination(60)
    read = lambda: sorted((r["k"], r["v"]) for r in csv_sink.read_csv_stream(spark, sink, "k int, v string").collect())
    assert read() == [(1, 'a "1", b')]  # what is not committed is not read
    monkeypatch.setattr(csv_sink, "write_csv", whole)
    row(3).write.mode("append").json(source)
    csv_sink.write_csv_stream(stream(), sink, check).awaitTermination(60)
    assert read() == [(i, f'a "{i}", b') for i in (1, 2, 3)]


def test_a_killed_run_goes_on(spark, tmp_path):
    made = []

    def part(name, fail=False):
        def run():
            made.append(name)
            if fail:
                raise RuntimeError("killed")
            return spark.createDataFrame([(name, len(made))], "name string, n int")

        return run

    book = ledger.Ledger(spark, str(tmp_path / "l"))
    assert book.run("a", part("a")).first()["n"] == 1
    with pytest.raises(RuntimeError):
        book.run("b", part("b", fail=True), {"w": 1})
    again = ledger.Ledger(spark, str(tmp_path / "l"))
    assert again.run("a", part("a")).first()["n"] == 1 and again.run("b", part("b"), {"w": 1}).first()["n"] == 3 and again.run("b", part("b"), {"w": 2}).first()["n"] == 4
    assert made == ["a", "b", "b", "b"] and sorted((r["name"], r["rows"]) for r in again.entries().collect()) == [("a", 1), ("b", 1), ("b", 1)]


def test_variants_are_taken_up_where_they_stopped(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(2)
    rows = []
    for i in range(40):
        s = "".join(r.choice(list("ACGU"), 20))
        s = s[:1] + ("GAGGUAG", "CCCUGAG", "AAAGUGC")[i % 3] + s[8:] if i < 9 else s
        rows.append((f"m{i:03d}", s, s[1:8], int(i < 9), 1.0))
    entries = spark.createDataFrame(rows, "name string, sequence string, family string, positive int, evidence double")
    long = spark.createDataFrame([(f"s{s:02d}", s % 2, f"f{j}", float(r.random() + (s % 2) * (j == 1))) for s in range(40) for j in range(4)], "sample string, label int, feature string, value double")
    features = spark.createDataFrame([(f"m{i:03d}", f"f{i % 4}") for i in range(9, 40)], "name string, features string")
    external = spark.createDataFrame([(f"m{i:03d}", "exact" if i % 2 else "absent", i % 3 == 0, i % 4 == 0) for i in range(9, 40)], "candidate string, method string, replicated_exact boolean, practical boolean")
    variants = {"all": {}, "less": {"m000": 0.0, "m001": 2.0}}
    options = {"bags": 2, "size": 12, "epochs": 6}
    run = lambda book: sorted(tuple(x) for x in pipelines.sensitivity_ranks(entries, long, features, external, variants, book, **options).collect())
    whole = run(ledger.Ledger(spark, str(tmp_path / "a")))
    assert len(whole) == 8 and {x[-1] for x in whole} == {"all", "less"}
    calls, model = [], learning.rank_candidates

    def counted(changed, **given):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return model(changed, **given)

    monkeypatch.setattr(learning, "rank_candidates", counted)
    with pytest.raises(RuntimeError):
        run(ledger.Ledger(spark, str(tmp_path / "b")))
    assert run(ledger.Ledger(spark, str(tmp_path / "b"))) == whole and len(calls) == 3  # the first variant is not computed again


def test_one_class_ranking_equals_a_plain_version(spark, monkeypatch):
    r = np.random.default_rng(5)
    word = lambda n: "".join(r.choice(list("ACGU"), n))
    mine = {i: word(int(r.integers(0, 30))) for i in range(20)} | {20: "ACGUACGUAC"}
    theirs = {i: word(int(r.integers(9, 30))) for i in range(6)} | {6: "ACGUACGUAC"}
    weight = {i: float(i % 3 + 1) for i in theirs}
    left = spark.createDataFrame(list(mine.items()), "entity int, sequence string")
    right = spark.createDataFrame([(i, s, weight[i]) for i, s in theirs.items()], "entity int, sequence string, weight double")
    vector = lambda s: learning.sequence_kmers(s, (2, 3))
    dot = lambda a, b: sum(x * b.get(f, 0.0) for f, x in a.items())
    cosine = lambda a, b: dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) if a and b else 0.0
    total = max(1.0, sum(weight.values()))
    center = {}
    for i, s in theirs.items():
        for f, x in vector(s).items():
            center[f] = center.get(f, 0.0) + weight[i] * x / total
    grams = lambda s: {s[j : j + 3] for j in range(len(s) - 2)}
    presence = {m: sum(weight[i] for i, s in theirs.items() if m in s) for s in theirs.values() for m in grams(s)}
    shown = [s for s in mine.values() if grams(s)]
    ratio = {m: math.log2(((p + 0.5) / (sum(weight.values()) + 1)) / ((sum(m in grams(s) for s in shown) + 0.5) / (len(shown) + 1))) for m, p in presence.items() if p >= 2}
    motifs = dict(sorted(((m, e) for m, e in ratio.items() if e > 0), key=lambda x: (-x[1], -presence[x[0]], x[0]))[:30])
    match = lambda a, b: sum(x == y for x, y in zip(a[1:8], b[1:8])) / max(1, len(a[1:8]), len(b[1:8]))
    for cells in (4_000_000, 100):  # one block of references, and a block for each
        monkeypatch.setattr(sequences, "REFERENCE_CELLS", cells)
        got = {x["entity"]: x for x in reports.one_class_ranking(left, right, [2, 3], [3]).collect()}
        for i, s in mine.items():
            near = max(cosine(vector(s), vector(t)) for t in theirs.values())
            coverage = sum(e for m, e in motifs.items() if m in s) / sum(motifs.values())
            seed = max(match(s, t) for t in theirs.values())
            want = {"centroid": cosine(vector(s), center), "nearest": near, "coverage": coverage, "seed": seed}
            assert all(abs(got[i][c] - x) < 1e-9 for c, x in want.items()), (i, want, got[i])
            assert abs(got[i]["score"] - min(1, max(0, 0.5 * want["centroid"] + 0.25 * near + 0.15 * coverage + 0.1 * seed))) < 1e-9
        assert got[20]["nearest_markers"].startswith("6:1.0;")


def test_planted_faults_are_found(spark):
    a = spark.createDataFrame([(1, 5.0, "x"), (1, -1.0, "y"), (2, None, None), (None, 3.0, "x"), (None, 4.0, "z")], "k int, v double, o string")
    b = spark.createDataFrame([("x",), ("x",), (None,)], "o string")
    out = checks.fused_suite(
        {"a": a, "b": b}, {"not negative": ("a", "v < 0"), "there": ("a", "v is null"), "b is there": ("b", "o is null"), "never": ("a", "v > 100")}, {"unique": ("a", ["k"]), "pairs": ("a", ["k", "v"])}, {"known": ("a", "o", "b", "o")}
    )
    got = {r["check"]: (r["table"], r["checked"], r["violations"], r["passed"]) for r in out.collect()}
    assert got == {
        "not negative": ("a", 5, 1, False), "there": ("a", 5, 1, False), "never": ("a", 5, 0, True), "b is there": ("b", 3, 1, False), "unique": ("a", 5, 2, False), "pairs": ("a", 5, 0, True), "known": ("a", 4, 2, False),
    }
    empty = checks.fused_suite({"a": a.limit(0)}, {"x": ("a", "v < 0")}, {"u": ("a", ["k"])}, {"r": ("a", "o", "a", "o")})
    assert {(r["checked"], r["violations"]) for r in empty.collect()} == {(0, 0)}


def test_kmers_are_counted_where_the_sequence_is(spark):
    texts = [(1, "ACGUACGUA", "x"), (1, "CGU", "x"), (2, None, "y"), (3, "AC", "y"), (4, "ANGA", "y"), (4, "", "y")]
    df = spark.createDataFrame(texts, "entity int, sequence string, side string")
    got = {(x["entity"], x["side"], x["feature"]): x["n"] for x in sequences.kmer_counts(df, [2, 3], keep=["side"]).collect()}
    want = {}
    for e, s, side in texts:
        for k in (2, 3):
            for i in range(len(s or "") - k + 1):
                want[(e, side, s[i : i + k])] = want.get((e, side, s[i : i + k]), 0) + 1
    assert got == want
    assert sequences.kmer_counts(df.limit(0), [2]).columns == ["entity", "feature", "n"]


def test_nearest_sequences_with_seeds_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    word = lambda n: "".join(r.choice(list("ACGU"), n))
    mine, theirs = {i: word(int(r.integers(0, 25))) for i in range(30)}, {i: word(int(r.integers(3, 25))) for i in range(17)}
    theirs |= {17: theirs[3], 18: theirs[3]}  # ties

    def vector(s):
        v = learning.sequence_kmers(s, (3,))
        n = max(0, len(s) - 2)
        return {f: x * n for f, x in v.items()} | {"seed:" + s[1:8]: 2.0}

    dot = lambda a, b: sum(x * b.get(f, 0.0) for f, x in a.items())
    left, right = (spark.createDataFrame(list(x.items()), "entity int, sequence string") for x in (mine, theirs))
    for cells in (4_000_000, 64 * 5):
        monkeypatch.setattr(sequences, "REFERENCE_CELLS", cells)
        got = {}
        for x in sequences.nearest_sequences(left, right, [3], 4).collect():
            got.setdefault(x["a"], {})[x["rank"]] = (x["b"], round(x["cosine"], 9))
        for i, s in mine.items():
            a = vector(s)
            near = sorted((-round(dot(a, vector(t)) / math.sqrt(dot(a, a) * dot(vector(t), vector(t))), 9), j) for j, t in theirs.items())
            want = [(j, -c) for c, j in near if c < 0][:4]
            assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want
