"""Near-duplicate embeddings by an exact metric range join.

Vectors of one label form a cell. A cell of many vectors may be split: some of its vectors become pivots, each vector's home is the cell of its
nearest pivot, and by the triangle inequality a vector can be within the range of a vector at home in another cell only if it lies within
the range of the border of the two and within the covering radius plus the range of that cell's pivot; to those cells (of two cells to one) it
is repeated as a visitor. Cells are split again until they are small, or until a sample says that a split would not halve the comparisons or would
repeat too many vectors; then each is compared on its own: home with home, home with visitors. A cell
whose covering radius is at most half the range is linked as a whole without comparing. Large cells are compared slab by slab in rounds that
shuffle each vector once or twice, so what lies on disk does not grow with the number of slabs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, hot_keys, hot_of, materialize, only, settled, written
from .graph import components
from .vectors import by_length

#: Home vectors of a cell that is not split, pivots of one split at most (cells are split again), and rows of one task of a split.
CELL_ROWS, PIVOTS, CHUNK_ROWS = 1024, 1024, 8192
#: A split is made if it leaves this share of the comparisons at most, and this many rows for a vector at home.
WORTH, REPEATS = 0.5, 1.5
#: Home vectors and visitors of one comparison as it is tallied, and rows that one kernel call takes, about.
HOME_BLOCK, VISITOR_BLOCK, TASK_ROWS = 2048, 4096, 8192
#: Rows whose products with four times as many are made together.
TILE = 512
#: Bytes of vectors of one slab, about: a kernel call takes two slabs.
SLAB_BYTES = 8 << 20
#: Up to this many cells (some 100 bytes each) are broadcast to the rows; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Widens every bound, far more than rounding can add up to.
SLACK = 1e-9
CELLS = "cell string, node long, w long, home boolean, far double, v binary, was double"


def raw_vectors(rows: DataFrame, single: bool) -> DataFrame:
    """(vec_id, label, v, digest) of (vec_id, label, embedding): a vector's bytes as they are given and the digest of its unit vector, null where it cannot be linked."""
    own_type = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            out: list[bytes | None] = [None] * batch.num_rows
            digest: list[bytes | None] = [None] * batch.num_rows
            ok = np.asarray(lists.is_valid()) & np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(1).is_valid())
            for size, (own, grid) in by_length(lists).items():
                own, grid = own[ok[own]], np.asarray(grid)[ok[own]]  # null components are nan here
                top = np.abs(grid).max(axis=1, initial=0.0)
                good = np.isfinite(top) & (top > 0)
                grid = grid[good].astype(own_type)
                for i, v, u in zip(own[good].tolist(), grid, units(grid), strict=True):
                    out[i], digest[i] = v.tobytes(), hashlib.blake2b(u, digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(digest, pa.binary())], ["vec_id", "label", "v", "digest"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary, digest binary")


def units(grid: np.ndarray) -> np.ndarray:
    """The rows as unit vectors in double precision."""
    grid = grid.astype(np.float64)
    grid /= np.abs(grid).max(axis=1, initial=0.0)[:, None]  # first to at most 1, so that squares neither overflow nor vanish
    grid /= np.sqrt((grid * grid).sum(axis=1))[:, None]
    grid += 0.0  # no negative zero
    return grid


def _grid(values: pa.ChunkedArray | pa.Array, single: bool) -> np.ndarray:
    """Unit vectors of vectors of one length that are held as bytes."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not len(values):
        return np.zeros((0, 0))
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return units(flat.view(np.float32 if single else np.float64).reshape(len(values), -1))


def choose_pivots(vectors: np.ndarray, n: int, reach: float) -> list[int]:
    """Up to n of the vectors, in their order, no two within ``reach``: the copies around one pivot get no second one."""
    chosen: list[int] = []
    near = np.full(len(vectors), np.inf)
    for i in range(len(vectors)):
        if len(chosen) < n and near[i] > reach:
            chosen.append(i)
            near = np.minimum(near, chord(vectors, vectors[i : i + 1])[:, 0])
    return chosen


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of two grids of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def visits(vectors: np.ndarray, home: np.ndarray, pivots: np.ndarray, radius: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether at home there): every row's own cell, and those where it may be within reach of a vector at home.

    Of two cells a vector at home here visits only the one of smaller number: a pair meets once.
    """
    far = chord(vectors, pivots)
    own = far.argmin(axis=1)
    line = np.arange(len(vectors))
    between = chord(pivots, pivots)
    np.fill_diagonal(between, 1.0)
    border = (far**2 - (far[line, own] ** 2)[:, None]) / (2 * between[own])  # how far the row is from the border of its cell and each other
    near = (border <= reach + SLACK) & (far <= radius[None, :] + reach + SLACK)
    near &= ~home[:, None] | (np.arange(len(pivots))[None, :] < own[:, None])
    near[line[home], own[home]] = True
    row, cell = np.nonzero(near)
    return row, cell, home[row] & (cell == own[row])


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Some of the pairs (row, column) that are linked, enough to join all that the linked pairs join."""
    rows, columns = linked.any(axis=1), linked.any(axis=0)
    out: list[tuple[int, int]] = []
    for first in np.flatnonzero(rows).tolist():
        if not rows[first]:
            continue
        rows[first] = False
        todo = [first]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(linked[i] & columns)
            columns[new] = False
            out += [(i, c) for c in new.tolist()]
            if len(new) and rows.any():
                left = np.flatnonzero(rows)
                met = linked[np.ix_(left, new)]
                some = met.any(axis=1)
                out += list(zip(left[some].tolist(), new[met[some].argmax(axis=1)].tolist(), strict=True))
                rows[left[some]] = False
                todo += left[some].tolist()
    return out


def linked_pairs(u: np.ndarray, v: np.ndarray, u32: np.ndarray, v32: np.ndarray, least: float, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) of the vectors u and v whose cosine, in double precision, is at least ``least``; single precision leaves few to look at."""
    size = u.shape[1]
    about = np.matmul(u32, v32.T, out=spare[: len(u) * len(v)].reshape(len(u), len(v)))
    some = np.float32(least - (size + 8) * 2.0**-22)  # more than single precision can be off by
    if not about.max(initial=-2) >= some:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(about >= some)
    if len(at) > about.size >> 6:
        return np.nonzero(u @ v.T >= least)
    rows, columns = np.divmod(at, len(v))
    step = max(1, (1 << 20) // max(1, size))
    some = [np.einsum("ij,ij->i", u[rows[c : c + step]], v[columns[c : c + step]]) >= least for c in range(0, len(at), step)]
    keep = np.concatenate([*some, np.zeros(0, bool)])
    return rows[keep], columns[keep]


def compare(u: np.ndarray, v: np.ndarray | None, w: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of the vectors u with those of v (None: among themselves, x is w): weights of each one's partners, and pairs that join what is linked."""
    inner = v is None
    v = u if inner else v
    u32 = u.astype(np.float32)
    v32 = u32 if inner else v.astype(np.float32)
    of_u, of_v = np.zeros(len(u)), np.zeros(len(v))
    pairs: list[tuple[int, int]] = []
    spare = np.empty(min(TILE, len(u)) * min(4 * TILE, len(v)), np.float32)
    for i in range(0, len(u), TILE):
        m = len(u[i : i + TILE])
        for j in range(i if inner else 0, len(v), 4 * TILE):
            k = len(v[j : j + 4 * TILE])
            rows, columns = linked_pairs(u[i : i + m], v[j : j + k], u32[i : i + m], v32[j : j + k], least, spare)
            if inner and j == i:  # the strip that begins on the diagonal: a pair counts once
                rows, columns = rows[rows < columns], columns[rows < columns]
            if not len(rows):
                continue
            of_u[i : i + m] += np.bincount(rows, x[j + columns], m)
            of_v[j : j + k] += np.bincount(columns, w[i + rows], k)
            found = zip(rows.tolist(), columns.tolist(), strict=True)
            if len(rows) > m + k:
                linked = np.zeros((m, k), bool)
                linked[rows, columns] = True
                found = spanning(linked)
            pairs += [(i + r, j + c) for r, c in found]
    if inner:
        of_u += of_v
    return of_u, of_v, pairs


def _compared(least: float, single: bool):  # noqa: ANN202
    """The kernel of many comparisons: rows (a, b, n) with a link (a, b) or, b null, a weight n of partners of a."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.stack([table[c].to_numpy() for c in ("cell", "visiting", "i", "j")])
        side, node, w = (table[c].to_numpy(zero_copy_only=False) for c in ("side", "node", "w"))
        vectors = table["v"].combine_chunks()
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, len(order)]
        a, b, n = [], [], []
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[begin:end]
            left, right = own[side[own] == 0], own[side[own] == 1]
            inner = not keys[1, begin] and keys[2, begin] == keys[3, begin]
            if len(left) + len(right) < 2 or not len(left) or (not inner and not len(right)):
                continue
            grids = [_grid(vectors.take(pa.array(x)), single) if len(x) else None for x in (left, right)]
            right = left if inner else right
            of_left, of_right, pairs = compare(grids[0], None if inner else grids[1], w[left], w[right], least)
            for who, found in ((left, of_left), *(() if inner else ((right, of_right),))):
                some = found > 0
                a += node[who[some]].tolist()
                b += [None] * int(some.sum())
                n += found[some].astype(np.int64).tolist()
            a += [int(node[left[r]]) for r, _ in pairs]
            b += [int(node[right[c]]) for _, c in pairs]
            n += [None] * len(pairs)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

    return run


def _visits_of(vectors: np.ndarray, home: np.ndarray, points: np.ndarray, radius: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`visits` of many vectors, some at a time."""
    step = max(64, (1 << 20) // len(points))
    parts = [(c, visits(vectors[c : c + step], home[c : c + step], points, radius, reach)) for c in range(0, len(vectors), step)]
    return np.concatenate([c + p[0] for c, p in parts]), np.concatenate([p[1] for _, p in parts]), np.concatenate([p[2] for _, p in parts])


def radii(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The covering radius of each pivot's own vectors, -1 without any."""
    out = np.full(len(points), -1.0)
    step = max(64, (1 << 20) // len(points))
    for c in range(0, len(vectors), step):
        far = chord(vectors[c : c + step], points)
        np.maximum.at(out, far.argmin(axis=1), far.min(axis=1))
    return out


def planned(vectors: np.ndarray, home: np.ndarray, m: int, reach: float) -> list[int]:
    """The pivots, among a sample of a cell's vectors, of the split that leaves the fewest comparisons; none if no split is worth it."""
    own = np.flatnonzero(home)
    own = own[:: max(1, len(own) // (4 * m))]
    chosen = own[choose_pivots(vectors[own], m, reach)].tolist()
    inside, outside = int(home.sum()), int((~home).sum())
    best, least = [], WORTH * inside * (inside / 2 + outside)
    while len(chosen) > 1:
        points = vectors[chosen]
        radius = radii(vectors[home], points)
        _, cell, at_home = _visits_of(vectors, home, points, radius, reach)
        h, g = np.bincount(cell[at_home], minlength=len(chosen)), np.bincount(cell[~at_home], minlength=len(chosen))
        cost = (h * (np.where(radius <= reach / 2 - SLACK, 0, h / 2) + g)).sum()
        if cost <= least and len(cell) <= max(REPEATS * inside, len(vectors)):
            best, least = chosen, cost
        chosen = chosen[: len(chosen) // 4]
    return best


def _pivots(rows: DataFrame, big: DataFrame, reach: float, cell_rows: int, single: bool) -> DataFrame:
    """(cell, chunks, j, p) of those of the big cells that a split is worth, judged by samples of about CHUNK_ROWS rows."""
    chunks = F.ceil(F.col("total") / CHUNK_ROWS).cast("int")
    big = big.select("cell", chunks.alias("chunks"), F.least(F.lit(PIVOTS), F.ceil(F.col("n") / cell_rows)).cast("int").alias("m"))
    sample = rows.join(F.broadcast(big), "cell").where(F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("chunks")) == 0).select("cell", "chunks", "m", "node", "home", "v")

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        chosen = planned(_grid(table["v"], single), table["home"].to_numpy(zero_copy_only=False), table["m"][0].as_py(), reach)
        some = table.take(pa.array(chosen, pa.int64()))
        return pa.Table.from_arrays([some["cell"], some["chunks"], pa.array(range(len(chosen)), pa.int32()), some["v"]], ["cell", "chunks", "j", "p"])

    return materialize(sample.groupBy("cell").applyInArrow(choose, "cell string, chunks int, j int, p binary"))


def _split(rows: DataFrame, big: DataFrame, pivots: DataFrame, reach: float, single: bool) -> DataFrame:
    """The rows of the big cells in the cells of their pivots."""
    big = pivots.select("cell", F.col("chunks").alias("dealt")).distinct().join(big.select("cell", "n"), "cell")
    active = rows.join(F.broadcast(big), "cell").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("dealt")).cast("int"))

    def measured(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("j")
        left = left.filter(left["home"])
        radius = np.zeros(0)
        if left.num_rows and right.num_rows:
            radius = radii(_grid(left["v"], single), _grid(right["p"], single))
        name = [right["cell"][0].as_py() if right.num_rows else ""] * len(radius)
        return pa.Table.from_arrays([pa.array(name, pa.string()), pa.array(range(len(radius)), pa.int32()), pa.array(radius)], ["cell", "j", "radius"])

    keys = ["cell", "chunk"]
    to_all = lambda df: df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    found = active.groupBy(*keys).cogroup(to_all(pivots).groupBy(*keys)).applyInArrow(measured, "cell string, j int, radius double")
    pivots = materialize(pivots.join(found.groupBy("cell", "j").agg(F.max("radius").alias("radius")), ["cell", "j"]))

    def dealt(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("j")
        home, far = left["home"].to_numpy(zero_copy_only=False), left["far"].to_numpy()
        row, at, own = np.arange(left.num_rows), np.zeros(left.num_rows, np.int64), home
        if left.num_rows and right.num_rows:
            vectors, points = _grid(left["v"], single), _grid(right["p"], single)
            row, at, own = _visits_of(vectors, home, points, right["radius"].to_numpy(), reach)
            far = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", vectors[row], points[at]), 0))
        some = left.take(pa.array(row))
        names = [f"{j}.{cell}" for j, cell in zip(at.tolist(), some["cell"].to_pylist(), strict=True)]
        return pa.Table.from_arrays(
            [pa.array(names, pa.string()), some["node"], some["w"], pa.array(own), pa.array(far), some["v"], pa.array(some["n"].to_numpy().astype(np.float64))], ["cell", "node", "w", "home", "far", "v", "was"]
        )

    return materialize(active.groupBy(*keys).cogroup(to_all(pivots).groupBy(*keys)).applyInArrow(dealt, CELLS))


def _of_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of the cells, with the cells' columns."""
    if cells.count() <= BROADCAST_CELLS:
        return rows.join(F.broadcast(cells), ["cell"])
    return hot_join(rows, cells, ["cell"], F.col("node"), hot_of(cells, "total", "cell"))


def _round(found: DataFrame, turn: int, bins: int) -> DataFrame:
    """The rows of the comparisons (cell, visiting, i, j) of one round: in each a slab at home meets one other and one slab of visitors at most.

    Slabs i and j meet in the round i + j, modulo their number, so each vector goes to one task of each kind and all slabs meet once.
    """
    block = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    most = F.greatest("homes", "guests")
    task = lambda visiting, i, j, side: F.struct(F.lit(visiting).alias("visiting"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    own, other = F.pmod(F.lit(turn) - F.col("block"), F.col("homes")), F.pmod(F.lit(turn) - F.col("block"), F.col("most"))
    among = F.when(F.col("home") & ~F.col("tight") & (F.col("homes") > turn), task(0, F.least("block", own), F.greatest("block", own), F.col("block") > own))
    met = F.when(F.col("home") & (other < F.col("guests")), task(1, F.col("block"), other, F.lit(0)))
    asked = F.when(~F.col("home") & (other < F.col("homes")), task(1, other, F.col("block"), F.lit(1)))
    tasks = found.withColumns({"block": block, "most": most}).withColumn("t", F.explode(F.array_compact(F.array(among, met, asked))))
    alone = F.xxhash64("id", "t.visiting", "t.i", "t.j")
    bin_ = F.when(F.col("total") > TASK_ROWS, alone).otherwise(F.pmod(F.xxhash64("id"), F.lit(bins)))
    return tasks.select(F.col("id").alias("cell"), "node", "w", "v", "t.*", bin_.alias("bin"))


def _linked(classes: DataFrame, least: float, cell_rows: int, tally: list | None, single: bool) -> DataFrame:
    """(a, b, n): links that join all that is linked, and weights of partners (b null), of the classes (node, label, w, v)."""
    reach = math.sqrt(2 - 2 * least)
    first = F.concat(F.lit(":"), F.length("v").cast("string"), F.lit(":"), F.col("label").cast("string"))
    rows = classes.select(first.alias("cell"), "node", "w", F.lit(True).alias("home"), F.lit(2.0).alias("far"), "v", F.lit(float("inf")).alias("was"))
    parts: list[tuple[DataFrame, DataFrame]] = []
    while True:
        whose = F.col("home")
        counts = materialize(rows.groupBy("cell").agg(
            F.sum(whose.cast("long")).alias("n"), F.count("*").alias("total"), F.max(F.when(whose, F.col("far"))).alias("radius"), F.max("was").alias("was"),
            F.sum(F.when(whose, F.col("w"))).alias("weight"), F.min(F.when(whose, F.col("node"))).alias("leader"), F.max(F.length("v")).alias("bytes"),
        ))
        tight = F.col("radius") <= reach / 2 - SLACK
        large = (F.col("n") > cell_rows) & ~tight & (F.col("n") <= 0.9 * F.col("was"))
        big, pivots = counts.where(large), None
        if not big.isEmpty():
            pivots = _pivots(rows, big, reach, cell_rows, single)
        done = counts if pivots is None else counts.join(pivots.select("cell").distinct(), "cell", "left_anti")
        slab = F.greatest(F.lit(1), F.lit(SLAB_BYTES) / F.greatest(F.lit(1), F.col("bytes")))
        done = done.where((F.col("total") > 1) & (F.col("n") > 0)).withColumn("tight", tight).withColumns(
            {"homes": F.ceil(F.col("n") / slab).cast("int"), "guests": F.ceil((F.col("total") - F.col("n")) / slab).cast("int")}
        )
        done = done.withColumn("id", F.monotonically_increasing_id() * 64 + len(parts))  # a number for each cell: splits are far fewer than 64
        parts.append((rows.drop("was", "far"), materialize(done.drop("was", "radius", "bytes"))))
        if pivots is None or pivots.isEmpty():
            break
        rows = _split(rows, big, pivots, reach, single)
    turns, work = 0, 0
    for _, cells in parts:
        homes, guests = F.ceil(F.col("n") / HOME_BLOCK), F.ceil((F.col("total") - F.col("n")) / VISITOR_BLOCK)
        compared = F.col("n") * (F.when(F.col("tight"), 0).otherwise(homes) + guests) + (F.col("total") - F.col("n")) * homes
        most, done, sums = cells.agg(F.max(F.greatest("homes", "guests")), F.sum(compared), F.sum("total")).first()
        turns, work = max(turns, most or 0), work + (sums or 0)
        if tally is not None:
            tally.append(done or 0)
    if tally is not None:
        tally[:] = [*tally[: len(tally) - len(parts)], sum(tally[len(tally) - len(parts) :])]
    links = []
    for turn in range(turns):
        found = [_of_cells(rows, cells.where(F.greatest("homes", "guests") > turn)) for rows, cells in parts]
        for more in found[1:]:
            found[0] = found[0].unionByName(more)
        tasks = _round(found[0], turn, max(1, -(-work // TASK_ROWS)))
        links.append(materialize(tasks.groupBy("bin").applyInArrow(_compared(least, single), "a long, b long, n long")))
    for rows, cells in parts:
        whole = _of_cells(rows.where("home").drop("v"), cells.where(F.col("tight") & (F.col("n") > 1)))
        links.append(whole.select(F.col("node").alias("a"), F.explode(F.array(
            F.struct(F.lit(None).cast("long").alias("b"), (F.col("weight") - F.col("w")).alias("n")), F.struct(F.col("leader").alias("b"), F.lit(None).cast("long").alias("n")),
        )).alias("f")).select("a", "f.b", "f.n"))
    for more in links[1:]:
        links[0] = links[0].unionByName(more)
    return materialize(links[0])


def near_duplicates(embeddings: DataFrame, least: float = 0.93, cell_rows: int = CELL_ROWS, tally: list | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding, label).

    Two rows are linked when their labels are equal and not null, their vectors have the same length and the cosine, in double
    precision, is at least ``least`` (over 0). ``n_links`` counts the other rows that a row is linked with, ``component_id`` is the smallest id
    reachable through links, its own included. Rows without id, label or vector, with a null or not finite component, or of
    zeros only are linked with nothing; their component is their id, and a row without id has none and is kept. Rows that repeat an id are
    rows of their own. Empty tables give empty results; further columns are ignored.

    Equal vectors of one label are one class with a weight before anything is compared, so exact copies cost one row. No cell is
    collected: splits and comparisons take blocks of bounded rows. Where vectors lie without clusters in many dimensions no
    metric bound can keep them apart and the comparisons are those of all pairs of a label, made slab by slab without repeating vectors
    on disk. Vectors are kept as they are given and made unit vectors where they are compared. ``tally`` gets the rows of all comparisons.
    """
    since = written()
    kind = embeddings.schema[embeddings.columns.index("embedding")].dataType.simpleString()
    rows = only(embeddings, "vec_id", "label", "embedding")
    single = kind == "array<float>"
    if kind != "array<double>" and not single:
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    vectors = raw_vectors(rows, single)
    rows = materialize(vectors.drop("v"))
    keys = ["label", "digest"]
    valid = rows.where("digest is not null")
    classes = vectors.where("digest is not null").groupBy(*keys).agg(F.min("vec_id").alias("first"), F.count("*").alias("w"), F.any_value("v").alias("v"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    links = _linked(classes, least, cell_rows, tally, single)
    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = components(links.where("b is not null").select("a", "b"))
    named = materialize(classes.select("node", "first").join(labels, "node"))
    leaders = named.groupBy("component").agg(F.min("first").alias("leader"))
    named = hot_join(named, leaders, ["component"], F.col("node"), hot_keys(named, "component")).select("node", "leader")
    facts = classes.select("node", *keys, "w", "first").join(counts, "node", "left").join(named, "node", "left")
    facts = facts.select(*keys, (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("leader", "first").alias("component_id"))
    out = hot_join(valid.select("vec_id", *keys), facts, keys, F.col("vec_id"), hot_of(classes, "w", *keys)).select("vec_id", "n_links", "component_id")
    lone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return settled(out, since)
