"""Clustering, range join and hard negatives against brute force, on odd input too."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import centroids, hard_negatives, range_join, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, VEC_ID string, v string, cluster string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y", "z") for i, v, y in rows], SCHEMA)


ODD = [
    (900, None, 1), (901, [], 1), (902, [1.0, None, 2.0], 1), (903, [1.0, float("nan"), 2.0], 1), (904, [1.0, float("inf"), 2.0], 1), (905, [0.0, 0.0, 0.0], 1), (None, [1.0, 2.0, 3.0], 1),
    (906, [1.0, 2.0, 3.0], None), (907, [1.0, 2.0], 1), (908, [1e300, 2e300, 3e300], 1), (909, [1e-300, 2e-300, 3e-300], 1), (700, [1.0, 2.0], 1),
]


def whole(v, scale, size=None):
    if v is None or any(x is None or not math.isfinite(x) for x in v) or (size is not None and len(v) != size):
        return None
    w = [math.floor(scale * x) for x in v]
    return w if sum(x * x for x in w) < 1 << 60 else None


# --- clustering ---


def cluster_plainly(rows, k, rounds, size, scale):
    kept = [(i, whole(v, scale, size)) for i, v, _ in rows if i is not None and whole(v, scale, size) is not None]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for turn in range(rounds + 1):
        far = [[sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in centres] for _, v in kept]
        own = [min(range(len(centres)), key=lambda c: (d[c], c)) for d in far]
        if turn < rounds:
            for c in range(len(centres)):
                members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
                if members:
                    centres[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    best = [d[o] for d, o in zip(far, own, strict=True)]
    return sorted(
        (i, o, d, sum(b for b, x in zip(best, own, strict=True) if x == o), sum(best), hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, own, best, strict=True)
    )


@pytest.mark.parametrize("k,rounds", [(5, 3), (16, 8), (400, 2), (1, 1)])
def test_clustering_equals_brute_force(spark, k, rounds):
    r = np.random.default_rng(k)
    heart = r.normal(size=(7, 3)) * 4
    rows = [(i, (heart[i % 7] + r.normal(size=3)).round(2).tolist(), None) for i in range(250)] + ODD + [(3, [1.0, 1.0, 1.0], 0), (3, [1.0, 1.0, 1.0], 0), (4, [1.0, 1.0, 1.0], 0)]
    tally = spark.sparkContext.accumulator(0)
    found = centroids.cluster(table(spark, rows), k, rounds, 3, 8, tally)
    want = cluster_plainly(rows, k, rounds, 3, 8)
    assert sorted(tuple(x) for x in found.collect()) == want
    if rounds == 8:  # bounds settle most of it once centroids rest
        assert tally.value < 0.7 * len(want) * (rounds + 1)
    assert found.schema == centroids.cluster(table(spark, rows).limit(0), k, rounds, 3, 8).schema


def test_ties_and_empty_clusters():
    points, centres = np.array([[1], [3], [9]]), np.array([[0], [2], [2], [100]])
    own, upper, lower, scans = centroids.reassign(points, np.zeros(3, np.int32), np.zeros(3), np.zeros(3), centres, None)
    assert own.tolist() == [0, 1, 1] and scans == 3 and (upper >= [1, 1, 7]).all() and (lower <= [1, 1, 7]).all()
    again, *_ = centroids.reassign(points, own, upper, lower, centres, centroids.drifts(centres, centres))
    assert again.tolist() == own.tolist()


def test_bounds_never_miss_a_move():
    r = np.random.default_rng(4)
    points = r.integers(-50, 50, (2000, 3))
    centres = points[:9].copy()
    state, before, scans = (np.zeros(2000, np.int64), np.zeros(2000), np.zeros(2000)), None, 0
    for _ in range(12):
        own, upper, lower, n = centroids.reassign(points, *state, centres, None if before is None else centroids.drifts(before, centres))
        far = vectors.distances(points, centres)
        assert (own == far.argmin(axis=1)).all() and (upper**2 >= far.min(axis=1) * (1 - 1e-12)).all()
        state, scans, before = (own, upper, lower), scans + n, centres
        centres = np.array([points[own == c].sum(axis=0) // max(1, (own == c).sum()) if (own == c).any() else centres[c] for c in range(9)])
    assert scans < 12 * 2000 * 0.7


def test_products_are_exact_beyond_doubles():
    a = np.array([[(1 << 29) + 1, 3], [5, -7]])
    b = np.array([[(1 << 29) + 1, 1]])
    assert vectors.products(a, b).tolist() == [[((1 << 29) + 1) ** 2 + 3], [5 * ((1 << 29) + 1) - 7]]


# --- range join ---


def links_plainly(rows, least):
    def unit(v):
        top = max(abs(x) for x in v)
        w = [x / top for x in v]
        n = math.sqrt(sum(x * x for x in w))
        return np.array([x / n for x in w])

    units = [unit(v) if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) else None for i, v, y in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= least:
                n[a] += 1
                n[b] += 1
                parent[root(a)] = root(b)
    smallest = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            smallest[root(i)] = min(smallest.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((i, n[k], smallest[root(k)] if i is not None else None, i is None or i == smallest[root(k)]) for k, (i, _, _) in enumerate(rows)), key=str)


def clustered(seed, n, size=3):
    r = np.random.default_rng(seed)
    heart = r.normal(size=(9, size))
    rows = []
    for i in range(n):
        spread = [0.02, 0.15, 0.4][i % 3]
        rows.append((i, (heart[r.integers(9)] + spread * r.normal(size=size)).tolist(), int(r.integers(10) < 3)))  # one label has most rows
    near = heart[0]
    rows += [(n + i, (near * (1 + i % 5) + 0.001 * r.normal(size=size)).tolist(), 0) for i in range(60)]  # near copies of one vector
    return rows + [(n + 60 + i % 20, near.tolist(), 0) for i in range(40)]  # copies, repeated ids too


@pytest.mark.parametrize("cell_rows,least,size", [(16, 0.93, 3), (10_000, 0.93, 3), (8, 0.5, 4)])
def test_range_join_equals_brute_force(spark, cell_rows, least, size, monkeypatch):
    monkeypatch.setattr(range_join, "HOME_BLOCK", 30)
    monkeypatch.setattr(range_join, "VISITOR_BLOCK", 25)
    monkeypatch.setattr(range_join, "CHUNK_ROWS", 50)
    rows = clustered(cell_rows, 240, size) + ODD
    found = range_join.near_duplicates(table(spark, rows), least, cell_rows)
    assert sorted((tuple(x) for x in found.collect()), key=str) == links_plainly(rows, least)
    assert found.schema == range_join.near_duplicates(table(spark, rows).limit(0), least, cell_rows).schema


def test_clusters_cost_less_than_all_pairs(spark):
    r = np.random.default_rng(1)
    heart = r.normal(size=(40, 16))
    rows = [(i, (heart[i % 40] + 0.05 * r.normal(size=16)).tolist(), 1) for i in range(4000)]
    plain, split = [], []
    few = range_join.near_duplicates(table(spark, rows), 0.93, 1 << 20, plain)
    assert few.exceptAll(range_join.near_duplicates(table(spark, rows), 0.93, 64, split)).isEmpty()
    assert plain == [8000] and split[0] < 2000  # two blocks make three comparisons; tight cells are linked without any


def test_large_cells_repeat_no_vectors_on_disk(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=24).tolist(), i % 2) for i in range(500)]  # no clusters: all lie within reach of all borders
    rows += [(1000 + i, (np.array(rows[i % 300][1]) + 0.1 * r.normal(size=24)).tolist(), i % 2) for i in range(100)]
    monkeypatch.setattr(range_join, "HOME_BLOCK", 40)
    monkeypatch.setattr(range_join, "CHUNK_ROWS", 150)
    monkeypatch.setattr(range_join, "SLAB_BYTES", 60 * 24 * 8, raising=False)  # five slabs of a label
    kept, write = [], range_join.materialize

    def counted(df):
        out = write(df)
        wide = [c for c in ("u", "v", "p") if c in out.columns]
        kept.append(out.agg(*[F.sum(F.length(c)) for c in wide]).first()[0] or 0 if wide else 0)
        return out

    monkeypatch.setattr(range_join, "materialize", counted)
    found = range_join.near_duplicates(table(spark, rows), 0.93, 32)
    assert sorted((tuple(x) for x in found.collect()), key=str) == links_plainly(rows, 0.93)
    assert sum(kept) <= 3 * len(rows) * 24 * 8  # were 13 times the vectors and more


def test_links_of_single_precision_tiles_are_those_of_double_precision(monkeypatch):
    r = np.random.default_rng(3)
    heart = r.normal(size=(6, 8))
    u = range_join.units((heart[r.integers(6, size=150)] + r.choice([0.001, 0.3], size=(150, 1)) * r.normal(size=(150, 8))).astype(np.float32))
    w = r.integers(1, 9, 150)
    monkeypatch.setattr(range_join, "TILE", 16)
    linked = u @ u.T >= 0.93
    np.fill_diagonal(linked, False)
    of_u, of_v, pairs = range_join.compare(u, None, w, w, 0.93)
    assert of_u.tolist() == (linked @ w).tolist() and all(linked[a, b] for a, b in pairs)
    of_u, of_v, pairs = range_join.compare(u[:70], u[70:], w[:70], w[70:], 0.93)
    assert of_u.tolist() == (linked[:70, 70:] @ w[70:]).tolist() and of_v.tolist() == (w[:70] @ linked[:70, 70:]).tolist()
    assert all(linked[a, 70 + b] for a, b in pairs)


def test_a_pair_meets_once_and_always():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = x[range_join.choose_pivots(x, 12, 0.3)]
    far = range_join.chord(x, pivots)
    radius = np.array([far[far.argmin(axis=1) == c, c].max(initial=-1) for c in range(len(pivots))])
    row, cell, home = range_join.visits(x, np.ones(300, bool), pivots, radius, 0.3)
    where = [{} for _ in range(300)]
    for i, c, h in zip(row.tolist(), cell.tolist(), home.tolist(), strict=True):
        where[i][c] = h
    close = range_join.chord(x, x) <= 0.3
    for a in range(300):
        for b in range(a):
            shared = [c for c in where[a] if c in where[b] and (where[a][c] or where[b][c])]
            assert len(shared) <= 1 and (len(shared) == 1 or not close[a, b])


# --- hard negatives ---


def negatives_plainly(rows, every, positives, k, percent, scale, relabel):
    kept = {}
    for i, v, y in rows:
        w = whole(v, scale)
        if i is not None and y is not None and w is not None:
            y = (y + 1) % 10 if relabel and i % relabel == 0 else y
            kept[i] = min(kept.get(i, (y, w)), (y, w))
    out = []
    for a, (y, v) in kept.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, (z, w) in kept.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scores if x[2] == y][:positives]:
            fit = [x for x in scores if x[2] != y and percent * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block_rows,chunk_bytes,relabel,scale", [(8192, 16 << 20, 7, 256), (37, 400, 0, 3), (64, 2000, 7, 1 << 24)])
def test_hard_negatives_equal_brute_force(spark, block_rows, chunk_bytes, relabel, scale):
    r = np.random.default_rng(block_rows)
    rows = [(i, r.normal(size=3).round(1).tolist(), int(r.integers(4))) for i in range(330)] + ODD + [(20, [3.0, 3.0, 3.0], 1), (20, [3.0, 3.0, 3.0], 1), (20, [9.0, 9.0, 9.0], 3), (100, [0.0, 0.0, 0.0], 2)]
    found = hard_negatives.hard_negatives(table(spark, rows), 10, 5, 5, 80, scale, relabel, block_rows, chunk_bytes)
    want = negatives_plainly(rows, 10, 5, 5, 80, scale, relabel)
    assert sorted(tuple(x) for x in found.collect()) == want and len(want) > 300
    assert hard_negatives.hard_negatives(table(spark, rows).limit(0)).schema == found.schema
    assert hard_negatives.hard_negatives(table(spark, [(1, [1.0], 1)])).count() == 0  # no anchor
