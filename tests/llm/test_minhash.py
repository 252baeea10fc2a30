import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import common, graph, minhash

SCHEMA = "doc_id long, text string, kept string"


def sets_of(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 3])
def test_equals_all_pairs(spark, prose, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    if block == 3:  # every key is hot, every text long, every call of the kernel takes one comparison
        monkeypatch.setattr(common, "HOT_ROWS", 2)
        monkeypatch.setattr(minhash, "TASK_SHINGLES", 100)
        monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    r = random.Random(5)
    rows, i = [], 100
    for family in range(4):
        base = prose(family, 80).split()
        for _ in range(14):  # copies of copies, from near to far
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6])):
                w[r.randrange(len(w))] = r.choice(["Uno", "dos", "TRES", "x%d" % r.randrange(50)])
            if r.random() < 0.4:
                base = w
            i -= 1
            rows.append((i, "  ".join(w)))
    rows += [(200, ""), (201, " \t\n"), (202, "one"), (203, "ONE"), (204, "one two"), (205, "é É x"), (206, "é É X"), (7, rows[0][1]), (7, rows[0][1]), (300, prose(99, 3000)), (301, prose(99, 3000) + " end")]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], SCHEMA)
    for k, percent in ((3, 85), (5, 80)):
        found = minhash.near_duplicates(df, k, percent).collect()
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found)
        assert got == sorted((d, n, c, d == c) for d, n, c in brute(rows, k, percent))
        left = {(r["doc_id"], r["text_hash"], r["component_id"]) for r in found if r["stays"] and r["n_shingles"]}
        assert len(left) == len({c for _, n, c in brute(rows, k, percent) if n})


def test_ids_that_repeat_with_other_texts(spark, prose):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(3, a), (7, a), (7, b), (9, b + " x1"), (9, b + " x1 x2"), (5, c), (5, c + " y"), (5, c + " z")]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], SCHEMA)
    found = minhash.near_duplicates(df).collect()
    assert [r["component_id"] for r in sorted(found, key=lambda r: (r["doc_id"], r["n_shingles"]))] == [3, 5, 5, 5, 3, 7, 7, 7]
    assert sorted(r["doc_id"] for r in found if r["stays"]) == [3, 5, 7]


def test_long_texts_are_read_in_pieces(prose, monkeypatch):
    text = "  " + prose(3, 900) + " " + "w" * 700 + "\n" + prose(4, 300).upper() + " end"
    other = prose(5, 200) + "  " + "v" * 5000
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in (text, other, "q" * 3000, " " * 3000)]
    whole = [(minhash.shingle_sets(b, "text", 3)) for b in batches]
    for size in (64, 177, 1000):
        monkeypatch.setattr(minhash, "SLICE", size)
        for b, (sets, at) in zip(batches, whole):
            got, ends = minhash.shingle_sets(b, "text", 3)
            assert (got == sets).all() and (ends == at).all()
            if len(sets):
                monkeypatch.setattr(minhash, "SLICE", 1 << 20)
                want = minhash.signatures(sets, at, 16), minhash._order_free(sets, at[:1])
                monkeypatch.setattr(minhash, "SLICE", size)
                assert (minhash.signatures(sets, at, 16) == want[0]).all() and (minhash._order_free(sets, at[:1]) == want[1]).all()


def test_comparisons_of_many_short_sets_are_small():
    import resource

    r = np.random.default_rng(4)
    m = 2 * minhash.BLOCK_ROWS
    sets = [np.sort(r.choice(np.arange(i % 7 * 25, i % 7 * 25 + 25), 20, replace=False)) for i in range(m)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    at = np.arange(0, 20 * m + 1, 20)
    pairs = minhash.joining_pairs(np.arange(m), np.arange(m), np.full(m, 20), np.concatenate(sets), at, None, 60)
    assert pairs and all(a % 7 == b % 7 for a, b in pairs) and len(pairs) < m
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "a b c", "a"), (None, "a b c", "a"), (2, "a b c", "a"), (3, "a b c", "a")], SCHEMA)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (None, 1, None, True), (None, 1, None, True), (2, 1, 2, True), (3, 1, 2, False)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signatures_are_circulant():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d e f", "", "x y z"])], ["text"])
    sets, at = minhash.shingle_sets(batch, "text", 3)
    assert list(np.diff(at)) == [4, 0, 1]
    sig = minhash.signatures(sets, at, 16)
    assert sig.shape == (2, 16) and len(set(sig[0].tolist())) > 8
    assert minhash.bands_for(85) < minhash.bands_for(80)


def test_common_counts():
    r = np.random.default_rng(3)
    rows, shingles = [], []
    for i in range(40):
        s = np.unique(np.r_[r.integers(0, 300, 30), np.arange(20) if i % 2 else []].astype(np.int64))
        rows += [i] * len(s)
        shingles += s.tolist()
    got = minhash.common_counts(np.array(rows), np.array(shingles), 40)
    got = np.maximum(got, got.T)
    for i in range(40):
        for j in range(i):
            a, b = {s for q, s in zip(rows, shingles) if q == i}, {s for q, s in zip(rows, shingles) if q == j}
            assert got[i, j] == len(a & b)


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(1, 2), (5, 5), (None, 3), (60, 50), (50, 55)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 1: 1, 2: 1, 50: 50, 55: 50, 60: 50}


def test_words_are_told_apart(spark):
    """Words of 1,024 letters that every polynomial modulo 2^64 confuses, and words across the pieces of a long text."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a + " u v"), (2, b + " u v"), (3, "x" + a + b + " u v"), (4, "x" + b + a + " u v"), (5, a + " U v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 3, 85).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


@pytest.mark.parametrize("size", [5, 16, 64, 1000])
def test_long_texts_are_read_whole(size, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE", size)
    r = random.Random(size)
    for n in (1, 2, 9, 60):
        text = "".join(r.choice([" ", "\n", "\t "]) + "".join(r.choice("abCDé") for _ in range(r.choice([1, 3, 7, 8, 9, 17, 40, 2 * size]))) for _ in range(n))
        for t in (text, text.strip(), text + " "):
            data = np.frombuffer(t.encode(), np.uint8)
            whole = minhash._words(data, np.array([0, len(data)]))[1]
            assert minhash._long_words(data).tolist() == whole.tolist() and len(set(whole.tolist())) == len({re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.split(r"[\x20\x09-\x0d]+", t) if w})


def test_stars_of_settled_components_are_not_confirmed_again(spark, monkeypatch):
    sets = [(i, [*range(100), 1000 + i]) for i in range(12)] + [(i, [*range(500, 600), 1000 + i]) for i in range(12, 16)] + [(20, [*range(800, 900)])]
    stars = [(i, 0) for i in range(1, 12)] + [(i, 1) for i in range(2, 12)] + [(i, 0) for i in range(13, 16)] + [(i, 12) for i in range(13, 16)] + [(20, 12)]
    asked, confirm = [], minhash._confirm
    monkeypatch.setattr(minhash, "_confirm", lambda pairs, *more: asked.append(pairs.count()) or confirm(pairs, *more))
    of_sets = spark.createDataFrame(sets, "node long, shingles array<long>")
    found = minhash._star_links(spark.createDataFrame(stars, "a long, b long"), of_sets, 85)
    labels = {r["node"]: r["component"] for r in minhash.components(found).collect()}
    assert labels == {**dict.fromkeys(range(12), 0), **dict.fromkeys(range(12, 16), 12)}
    assert asked == [15, 3]  # of 28 stars


def test_full_sets_move_only_where_sketches_leave_a_link_open(spark, prose):
    rows, r = [], random.Random(8)
    for family in range(3):  # texts that share buckets, hardly any of them a link
        base = prose(family, 700).split()
        for _ in range(40):
            w = list(base)
            for p in r.sample(range(len(w)), 33):
                w[p] = "z%d" % r.randrange(10**6)
            rows.append((len(rows), " ".join(w), "z"))
    rows += [(500 + i, rows[40 * i][1] + " end", "z") for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def shuffled():
        time.sleep(0.2)  # the store takes in no more than a few states a second
        spark.range(1).count()
        bus.waitUntilEmpty()
        return sum(x.totalShuffleWrite() for x in (lambda found: (found.apply(i) for i in range(found.size())))(store.executorList(False)))

    before = shuffled()
    found = minhash.near_duplicates(df, 3, 85).collect()
    moved = shuffled() - before
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in found) == sorted(brute([x[:2] for x in rows], 3, 85))
    assert moved < 8 * sum(x["n_shingles"] for x in found)  # all full sets once


def test_sketches_rule_out_no_link(monkeypatch):
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2))]
    for changed in (0, 5, 20, 24, 25, 26, 30, 60, 200, 300):
        for _ in range(6):
            kept = r.permutation(sets[0])[changed:]
            sets.append(np.unique(np.r_[kept, r.integers(0, 1 << 63, r.integers(0, changed + 1), dtype=np.uint64) * np.uint64(2)]))
    sets.append(sets[0][:0])
    n, at = np.array([len(s) for s in sets]), np.r_[0, np.cumsum([len(s) for s in sets])]
    sketches = minhash.parity_sketches(np.concatenate(sets), at)
    common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    alike = (common * 100 >= (n[:, None] + n - common) * 85) & ~np.eye(len(n), dtype=bool) & (common > 0)
    differing = np.bitwise_count(sketches[:, None] ^ sketches).sum(axis=2)
    assert (differing <= n[:, None] + n - 2 * common).all() and alike.any()
    lower = np.arange(len(n)) % 3 == 0
    for some in (None, lower):
        true = alike if some is None else alike & (lower[:, None] != lower)
        got = minhash.with_possible_partner(sketches, np.arange(len(n)), n, some, 85)
        assert got[true.any(axis=1)].all() and not got[-8:-1].any()
    assert not minhash.with_possible_partner(sketches, np.zeros(len(n)), n, None, 85).any()
    monkeypatch.setattr(minhash, "SLICE", 50)
    assert (minhash.parity_sketches(sets[0], at[:2]) == sketches[:1]).all()
