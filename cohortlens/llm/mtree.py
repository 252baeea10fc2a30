"""Exact top-k by inner product with M-trees.

Vectors go to the nearest of a few pivots, and the vectors of a pivot to trees of bounded size. A tree's nodes are pages in a table:
inner entries hold a routing vector, its distance to the parent's routing vector, a covering radius and a child; leaf entries
hold a vector, its parent distance and the ids that share it. A best-first search opens the page with the largest bound first.
By the triangle inequality a score is at most the parent's score plus the query's norm times a stored distance, so
entries below the k-th best score are passed over without computing anything of theirs. The pivots with the radii around them are
the level above the trees: a query first visits one tree near it, and then only trees that may hold a better score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, only, settled, written

#: Expected vectors of one tree, entries of one page, and queries that one search task takes.
TREE_ROWS = 8192
PAGE = 64
QUERY_BLOCK = 4096
#: Pivots at most, one for each tree until then, and vectors they are chosen from.
PIVOTS, PIVOT_SAMPLE = 4096, 16384
TREE = ["size", "cell", "tree"]
PAGES = "size int, cell int, tree int, node long, leaf boolean, vectors binary, parent_distance array<double>, radius array<double>, child array<long>, ids array<array<long>>"


def quantize(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null for a vector that is null or holds null or non-finite components."""
    x = F.transform(embedding, lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(x, lambda c: F.floor(c * scale)))


def build_pages(ids: np.ndarray, vectors: np.ndarray) -> Iterator[dict]:
    """The pages of the tree over (ids, vectors); page 0 is the root. Equal vectors are one entry."""
    distinct, back = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, back.ravel()))
    cuts = np.flatnonzero(np.diff(back.ravel()[order])) + 1
    owners = [x.tolist() for x in np.split(ids[order], cuts)]
    points = distinct.astype(np.float64)
    todo: list[tuple[int, np.ndarray, np.ndarray | None]] = [(0, np.arange(len(points)), None)]
    used = 1
    while todo:
        node, at, pivot = todo.pop()
        far = np.zeros(len(at)) if pivot is None else np.linalg.norm(points[at] - pivot, axis=1)
        if len(at) <= PAGE:
            yield {"node": node, "leaf": True, "vectors": distinct[at], "parent_distance": far, "radius": np.zeros(len(at)), "child": [], "ids": [owners[i] for i in at]}
            continue
        # routing objects: each the point farthest from those before; all points go to the nearest
        chosen = [int(np.argmax(far))]
        near, home = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
        for k in range(min(PAGE // 2, -(-len(at) // (PAGE // 2)))):
            d = np.linalg.norm(points[at] - points[at[chosen[k]]], axis=1)
            closer = d < near
            near[closer], home[closer] = d[closer], k
            chosen.append(int(np.argmax(near)))
        routing, radius, child = [], [], []
        for k in range(home.max() + 1):
            own = at[home == k]
            if len(own):
                routing.append(at[chosen[k]])
                radius.append(float(near[home == k].max()))
                child.append(used)
                todo.append((used, own, points[at[chosen[k]]]))
                used += 1
        routing = np.array(routing)
        gap = np.zeros(len(routing)) if pivot is None else np.linalg.norm(points[routing] - pivot, axis=1)
        yield {"node": node, "leaf": False, "vectors": distinct[routing], "parent_distance": gap, "radius": np.array(radius), "child": child, "ids": []}


class Searcher:
    """Best-first search in one tree; counts the inner products it computes and those it passes over."""

    def __init__(self, pages: dict[int, dict], top: float):
        self.pages, self.top, self.computed, self.avoided = pages, top, 0, 0

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) of all but ``own``, ties to smaller ids; scores below ``floor`` may be left out."""
        norm = float(np.linalg.norm(query.astype(np.float64)))
        slack = 0.25 + 1e-12 * norm * self.top
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst is first
        queue: list[tuple[float, int, float]] = [(-np.inf, 0, np.nan)]
        while queue:
            bound, node, parent = heapq.heappop(queue)
            limit = max(floor, best[0][0] if len(best) == k else -np.inf) - slack
            if -bound < limit:
                break
            page = self.pages[node]
            vectors = page["vectors"]
            if parent == parent and limit > -np.inf:  # not the root: the parent's score bounds the entries
                keep = np.flatnonzero(parent + norm * (page["parent_distance"] + page["radius"]) >= limit)
            else:
                keep = np.arange(len(vectors))
            self.avoided += len(vectors) - len(keep)
            if not len(keep):
                continue
            self.computed += len(keep)
            scores = vectors[keep] @ query
            if page["leaf"]:
                for i in np.argsort(-scores, kind="stable").tolist():
                    score = int(scores[i])
                    if len(best) == k and score < best[0][0]:
                        break
                    for x in [y for y in page["ids"][keep[i]][: k + 1] if y != own][:k]:
                        if len(best) < k:
                            heapq.heappush(best, (score, -x))
                        elif (score, -x) > best[0]:
                            heapq.heapreplace(best, (score, -x))
                        else:
                            break
            else:
                bounds = scores + norm * page["radius"][keep]
                for b, i, s in zip(bounds.tolist(), keep.tolist(), scores.tolist(), strict=True):
                    if b >= limit:
                        heapq.heappush(queue, (-b, page["child"][i], float(s)))
        return [(s, -x) for s, x in sorted(best, reverse=True)]


def choose_pivots(vectors: DataFrame, n: int, tree_rows: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector: of a bounded sample, those with the smallest hashes of their ids, each the farthest from those before."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    out: dict[int, np.ndarray] = {}
    for size in {len(r["v"]) for r in rows}:
        points = np.array([r["v"] for r in rows if len(r["v"]) == size], np.float64).reshape(-1, size)
        chosen, near = [0], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < min(PIVOTS, -(-n // tree_rows)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(points - points[chosen[-1]], axis=1))
        out[size] = points[chosen]
    return out


class Routing:
    """The level above the trees, by length of vector: pivots, covering radii, and how many trees each pivot has."""

    def __init__(self, pivots: dict[int, np.ndarray], cells: list[tuple[int, int, float, int]]):
        self.pivots = {size: p for size, p in pivots.items()}
        self.radius = {size: np.full(len(p), -np.inf) for size, p in pivots.items()}
        self.trees = {size: np.zeros(len(p), np.int64) for size, p in pivots.items()}
        for size, cell, radius, trees in cells:
            if size not in self.pivots:  # a length that the sample lacks: one pivot at 0
                self.pivots[size], self.radius[size], self.trees[size] = np.zeros((1, size)), np.full(1, -np.inf), np.zeros(1, np.int64)
            self.radius[size][cell], self.trees[size][cell] = radius, trees

    def visits(self, query: np.ndarray, floor: float, home: bool) -> list[tuple[int, int]]:
        """(cell, tree) of the trees to search: the first of the most promising cell, or all others whose bound reaches ``floor``."""
        if len(query) not in self.pivots:
            return []
        score, norm = self.pivots[len(query)] @ query, float(np.linalg.norm(query))
        trees = self.trees[len(query)]
        best = int(np.where(trees > 0, score, -np.inf).argmax())
        if home:
            return [(best, 0)]
        bound = score + norm * self.radius[len(query)]
        slack = 0.25 + 1e-9 * np.abs(bound[np.isfinite(bound)]).max(initial=0)
        return [(c, t) for c in np.flatnonzero((trees > 0) & (bound >= floor - slack)).tolist() for t in range(int(trees[c])) if (c, t) != (best, 0)]


def one_an_id(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with the smallest vector of each id. Vectors are shuffled only where an id repeats; the check shuffles ids."""
    vectors = materialize(vectors.select("vec_id", "v"))
    if vectors.groupBy("vec_id").count().where("count > 1").isEmpty():
        return vectors
    return materialize(vectors.groupBy("vec_id").agg(F.min("v").alias("v")))


def build_index(vectors: DataFrame, tree_rows: int = TREE_ROWS) -> tuple[DataFrame, Routing]:
    """The pages of all trees, written to the shared folder, and the routing to them.

    ``vectors`` is (vec_id, v array<long>). Each goes to its nearest pivot; the vectors of a pivot are dealt by the hash of the id
    over trees of about ``tree_rows``, so equal vectors, however many, spread over trees. Vectors of different lengths are
    in different trees. Ids are expected once, see :func:`one_an_id`.
    """
    spark = vectors.sparkSession
    pivots = choose_pivots(vectors, vectors.count(), tree_rows)
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            lists = batch.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                points = flat[ends[own][:, None] + np.arange(size)[None, :]].astype(np.float64)
                near = np.full(len(own), np.inf)
                for c, pivot in enumerate(shared.value.get(size, np.zeros((1, size)))):
                    d = np.linalg.norm(points - pivot, axis=1)
                    cell[own[d < near]] = c
                    near = np.minimum(near, d)
                far[own] = near
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes.astype(np.int32)), pa.array(cell), pa.array(far)], ["vec_id", "v", "size", "cell", "far"])

    def build(table: pa.Table) -> pa.Table:
        ids, size = table["vec_id"].to_numpy(), int(table["size"][0].as_py())
        flat = table["v"].combine_chunks().flatten().to_numpy() if size else np.zeros(0, np.int64)
        grid = flat.reshape(len(ids), size).astype(np.int64)
        order = np.lexsort((*grid.T[::-1], ids))
        first = order[np.r_[True, np.diff(ids[order]) != 0]]
        out = list(build_pages(ids[first], grid[first]))
        return pa.Table.from_arrays(
            [
                *(pa.array([table[c][0].as_py()] * len(out), t) for c, t in (("size", pa.int32()), ("cell", pa.int32()), ("tree", pa.int32()))),
                pa.array([p["node"] for p in out], pa.int64()), pa.array([p["leaf"] for p in out]),
                pa.array([p["vectors"].astype("<i8").tobytes() for p in out], pa.binary()), pa.array([p["parent_distance"].tolist() for p in out], pa.list_(pa.float64())),
                pa.array([np.asarray(p["radius"]).tolist() for p in out], pa.list_(pa.float64())), pa.array([p["child"] for p in out], pa.list_(pa.int64())),
                pa.array([p["ids"] for p in out], pa.list_(pa.list_(pa.int64()))),
            ],
            [*TREE, "node", "leaf", "vectors", "parent_distance", "radius", "child", "ids"],
        )

    before = written()
    placed = materialize(vectors.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<long>, size int, cell int, far double"))
    cells = placed.groupBy("size", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / tree_rows).cast("int").alias("trees"))
    cells = materialize(cells)  # a row for each pivot and length
    dealt = placed.join(F.broadcast(cells.select("size", "cell", "trees")), ["size", "cell"]).withColumn("tree", F.pmod(F.xxhash64("vec_id"), F.col("trees")).cast("int"))
    routing = Routing(pivots, [tuple(r) for r in cells.select("size", "cell", "radius", "trees").collect()])
    return settled(dealt.groupBy(*TREE).applyInArrow(build, PAGES), before), routing


def _search(pages: DataFrame, asked: DataFrame, k: int, tally: tuple | None) -> DataFrame:
    """(query_id, vec_id, score): the best k of each (tree, query) that ``asked`` (query_id, v, floor, size, cell, tree) names.

    The queries of a tree are dealt over blocks of about QUERY_BLOCK; the tree's pages are repeated for each.
    """
    asked = materialize(asked)
    blocks = asked.groupBy(*TREE).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    blocks = materialize(blocks)
    spread = pages.join(blocks.toDF(*TREE, "of"), TREE).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).drop("of")
    dealt = asked.join(blocks.toDF(*TREE, "over"), TREE).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("over")).cast("int")).drop("over")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            size, nodes, top, held = right["size"][0].as_py(), {}, 0.0, 0
            for r in left.to_pylist():
                grid = np.frombuffer(r["vectors"], "<i8").reshape(-1, size) if size else np.zeros((len(r["parent_distance"]), 0), np.int64)
                top = max(top, float(np.linalg.norm(grid.astype(np.float64), axis=1).max(initial=0)))
                held += len(grid) * r["leaf"]
                nodes[r["node"]] = {"leaf": r["leaf"], "vectors": grid, "parent_distance": np.array(r["parent_distance"]), "radius": np.array(r["radius"]), "child": r["child"], "ids": r["ids"]}
            tree = Searcher(nodes, top)
            for own, v, floor in zip(*(right[c].to_pylist() for c in ("query_id", "v", "floor")), strict=True):
                out += [(own, x, s) for s, x in tree.search(np.array(v, np.int64), own, k, floor)]
            if tally:
                tally[0].add(tree.computed)
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    keys = [*TREE, "block"]
    return materialize(spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, tree_rows: int = TREE_ROWS, tally: tuple | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products, ties to smaller ids.

    Both inputs are (vec_id long, v array<long>), as :func:`quantize` makes them; sums of products must fit 64 bits. Null ids and
    null vectors take no part; a query meets vectors of its own length and never its own id; with fewer than k others it gets all.
    Rows that repeat an id count once, the one with the smallest vector. Empty inputs give an empty result.

    A query's first tree gives a k-th best score; it then goes to those trees only whose bound reaches it. Both passes are joins of
    pages with bounded blocks of queries. Each tree returns at most k rows a query, a window per query merges them. ``tally``,
    two accumulators, gets the inner products that were computed, and those of all pairs.
    """
    vectors = one_an_id(only(vectors, "vec_id", "v").where("vec_id is not null and v is not null"))
    queries = only(queries, "vec_id", "v").where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialize(queries.withColumnRenamed("vec_id", "query_id"))
    pages, routing = build_index(vectors, tree_rows)
    shared = queries.sparkSession.sparkContext.broadcast(routing)
    if tally:
        tally[1].add(vectors.count() * queries.count())

    def routed(home: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, cells, trees = [], [], []
                for i, (v, floor) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    for c, t in shared.value.visits(np.array(v, np.float64), floor, home):
                        at.append(i)
                        cells.append(c)
                        trees.append(t)
                some = batch.take(pa.array(at, pa.int64()))
                sizes = [len(v) for v in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(x, pa.int32()) for x in (sizes, cells, trees))], ["query_id", "v", "floor", *TREE])

        return run

    schema = "query_id long, v array<long>, floor double, size int, cell int, tree int"
    first = _search(pages, queries.withColumn("floor", F.lit(float("-inf"))).mapInArrow(routed(True), schema), k, tally)
    reached = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("floor"))
    left = queries.join(reached, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = first.unionByName(_search(pages, left.mapInArrow(routed(False), schema), k, tally)).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
