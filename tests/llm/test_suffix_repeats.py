import collections
import hashlib
import random

import numpy as np
import pytest

from cohortlens.llm import common
from cohortlens.llm import suffix_repeats as S


def brute(texts, least):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + least] for b in raw for p in range(len(b) - least + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] > 1:
                cover[p : p + least] = b"\1" * least
        kept = bytes(c for c, m in zip(b, cover) if not m)
        runs = sum(1 for i in range(len(cover)) if cover[i] and (not i or not cover[i - 1]))
        out.append((len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(prose):
    r = random.Random(3)
    passages = [prose(1000 + k, 60) for k in range(4)]
    texts = []
    for i in range(40):
        t = prose(i, r.randint(5, 120))
        for _ in range(r.choice([0, 0, 1, 2])):
            p, at = r.choice(passages), r.randrange(len(t))
            a = r.randrange(60)
            t = t[:at] + p[a : a + r.randint(150, 330)] + t[at:]
        texts.append(t)
    return [*texts, None, "", "short", texts[0], texts[0], "ab" * 400, "é" * 300, prose(7, 2500) + passages[0] + prose(8, 2500)]


@pytest.mark.parametrize("chunk", [16384, 3])
def test_equals_brute_force(spark, prose, chunk, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", chunk)
    texts = corpus(prose)
    rows = [(i % 45, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = collections.Counter(tuple(r) for r in S.digest_removed(df).collect())
    assert got == collections.Counter((i % 45, *x[:4]) for i, x in enumerate(brute(texts, S.LEAST)))


@pytest.mark.parametrize("chunk", [16384, 3])
def test_repeat_groups_hold_all_occurrences(spark, prose, chunk, monkeypatch):
    """Every group is one string with all its occurrences anywhere; together they cover what brute force says is repeated."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    texts = corpus(prose)
    raw = [(t or "").encode() for t in texts]
    rows = [(i, t, "k") for i, t in enumerate(texts)]
    found = collections.defaultdict(list)
    df = spark.createDataFrame(rows, "doc_id long, text string, d string").repartition(3)
    for r in S.repeat_groups(df).collect():
        found[r["group_id"]].append((r["length"], r["doc_id"], r["begin"]))
    cover = [bytearray(len(b)) for b in raw]
    assert len({raw[m[0][1]][m[0][2] : m[0][2] + m[0][0]] for m in found.values()}) == len(found) > 0
    for members in found.values():
        n, i, p = members[0]
        string = raw[i][p : p + n]
        everywhere = sorted((n, j, q) for j, b in enumerate(raw) for q in range(len(b) - n + 1) if b.startswith(string, q))
        assert n >= S.LEAST and sorted(members) == everywhere and len(members) > 1
        for _, j, q in members:
            cover[j][q : q + n] = b"\1" * n
    assert [sum(c) for c in cover] == [x[1] for x in brute(texts, S.LEAST)]
    if chunk > 3:
        assert max(m[0][0] for m in found.values()) > S.LEAST


@pytest.mark.parametrize("chunk", [16384, 1])
def test_a_long_passage_is_one_group(spark, prose, chunk, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", chunk)
    long, other = prose(40, 900), prose(41, 120)
    texts = ["a" + long + "b" + prose(1, 80), prose(2, 90) + "c" + long + "d", "e" + other + "f", prose(3, 50) + "g" + other, "h" + other + "i" + prose(4, 60)]
    got = collections.defaultdict(set)
    for r in S.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[(r["group_id"], r["length"])].add((r["doc_id"], r["begin"]))
    at = lambda part, which: {(i, texts[i].index(part)) for i in which}
    assert sorted((n, sorted(m)) for (_, n), m in got.items()) == sorted([(len(long), sorted(at(long, (0, 1)))), (len(other), sorted(at(other, (2, 3, 4))))])


def test_repeat_groups_of_odd_rows(spark, prose):
    p = prose(5, 60)
    schema = "doc_id long, text string"
    got = {(r["doc_id"], r["begin"]) for r in S.repeat_groups(spark.createDataFrame([(None, p), (1, p), (1, "x" + p), (2, None), (3, ""), (4, "short")], schema)).collect()}
    assert {i for i, _ in got} == {None, 1} and {(None, 0), (1, 0), (1, 1)} <= got
    assert S.repeat_groups(spark.createDataFrame([], schema)).count() == 0


def test_removal_keeps_columns_and_characters(spark, prose):
    p = "é" + prose(5, 60)
    texts = ["a" + p + "b", "ü" + p + "c", None, "x"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, d string")
    got = {r["doc_id"]: r["text"] for r in S.remove_repeats(df).collect()}
    assert got == {0: "ab", 1: "üc", 2: None, 3: "x"}
    assert S.remove_repeats(df).columns == df.columns and S.digest_removed(df.limit(0)).count() == 0


def test_maximal_repeats_are_maximal():
    r = random.Random(9)
    for _ in range(40):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 30))) for _ in range(4)]
        array = S.suffix_array(texts, np.zeros(4, int))
        suffixes = [texts[t][o:] for t, o in zip(array["text"], array["offset"])]
        assert suffixes == sorted(suffixes)
        got = {(suffixes[first][:n], last - first + 1) for n, first, last in S.maximal_repeats(array, 2)}
        want = set()
        for t in texts:
            for i in range(len(t)):
                for j in range(i + 2, len(t) + 1):
                    w = t[i:j]
                    at = [(x, k) for x in texts for k in range(len(x)) if x.startswith(w, k)]
                    right = {x[k + len(w) : k + len(w) + 1] for x, k in at}
                    left = {x[k - 1 : k] if k else None for x, k in at}
                    ends = sum(k + len(w) == len(x) for x, k in at)
                    begins = sum(k == 0 for _, k in at)
                    if len(at) > 1 and (len(right) > 1 or ends > 1) and (len(left) > 1 or begins > 1):
                        want.add((w, len(at)))
        assert got == want


def test_repeat_groups_keep_few_tables_and_no_texts(spark, prose, monkeypatch):
    """A table goes when the next one is made of it, and texts are read where they lie, so disk is that of the largest step."""
    alive, columns, new, write = [], set(), common.new_folder, S.materialize

    def folder(session):
        path = new(session)
        alive.append(len(common._written))
        return path

    def materialize(df):
        columns.update(df.columns)
        return write(df)

    before = common.written()
    monkeypatch.setattr(common, "new_folder", folder)
    monkeypatch.setattr(S, "materialize", materialize)
    monkeypatch.setattr(S, "CHUNK", 2)
    p, q = prose(1, 90), prose(2, 90)
    texts = [p + q, q + p, p, p, prose(3, 60) + q[:300], None, ""]
    got = S.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert got and "text" not in columns
    assert max(alive) - before <= 6 and common.written() - before == 1
