"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signature coordinate k of a set is the minimum over its shingles x of p(s(x) + k), where s and p are two fixed
permutations of the 32-bit integers and the sum wraps around: one circularly shifted permutation serves
all coordinates. Sets that agree on all coordinates of a band are candidates; candidates are
confirmed on their full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import M32A, M32B, SLICE, held_by, hot_join, hot_keys, hot_of, materialize, mix64, only, slices, utf8
from .graph import components

ROWS_PER_BAND = 5
#: Chance that a pair right at the threshold shares no band.
MISS = 1e-6
#: Up to this many candidate ids (24 bytes each) are broadcast to the documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Sets and shingles of one block, about: a comparison takes two blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 125_000
#: Shingles of the comparisons that one kernel call makes, about.
TASK_SHINGLES = 500_000
#: 64-bit words of a parity sketch, a power of two; sketches of one block, and of the comparisons that one kernel call makes, about.
SKETCH_WORDS, SKETCH_ROWS, TASK_SKETCHES = 32, 1024, 2048
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are its hash as they are, one to one; longer words are hashed by a cryptographic function.
SHORT = 8
#: Long words whose hashes a worker remembers.
REMEMBERED = 20_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEPARATORS = (32, 9, 10, 11, 12, 13)
_remembered: dict[bytes, int] = {}


def bands_for(percent: int, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    """Bands needed to lose a pair of exactly this similarity with a chance below ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)) if percent < 100 else 1


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Each byte with A-Z as a-z, and which bytes separate words."""
    separates = np.zeros(256, bool)
    separates[list(SEPARATORS)] = True
    return np.frombuffer(LOWER, np.uint8), separates


def _long_hash(word: bytes) -> int:
    """64 bits of the BLAKE2b digest of a word; a table of bounded size spares most of the work, for words of bounded size."""
    found = _remembered.get(word)
    if found is None:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 32:
            if len(_remembered) >= REMEMBERED:
                _remembered.clear()
            _remembered[word] = found
    return found


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of the words of rows on end; no word spans two rows.

    Words of up to SHORT bytes are told apart with certainty at equal length: their bytes, as one number, are scrambled one to one.
    """
    lower, separates = _bytes()
    gap = separates[data]
    some = np.flatnonzero(np.diff(at) > 0)
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, gap[:-1]
    before[at[some]] = True
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = True, gap[1:]
    after[at[some + 1] - 1] = True
    begin, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    low = np.zeros(len(data) + SHORT, np.uint8)
    np.take(lower, data, out=low[: len(data)])
    size = end - begin
    eight = np.ndarray((len(data),), "<u8", low.data, strides=(1,))  # the eight bytes from each byte on
    word = eight[begin]
    unused = np.uint64(8) * (SHORT - np.minimum(size, SHORT)).astype(np.uint64)
    word <<= unused  # bytes beyond the word fall out
    mix64(word)
    word += size.astype(np.uint64) * BASE
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw = low.tobytes()
        word[long] = [_long_hash(raw[i:j]) for i, j in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
    return begin, mix64(word)


def _long_words(data: np.ndarray) -> np.ndarray:
    """The hashes of the words of one long text, which is read in pieces that end between words."""
    _, separates = _bytes()
    out, p = [], 0
    while p < len(data):
        end = min(p + SLICE, len(data))
        if end < len(data):
            gaps = np.flatnonzero(separates[data[p:end]])
            if len(gaps):
                end = p + int(gaps[-1]) + 1
            else:  # one word longer than a piece
                while end < len(data) and not (met := separates[data[end : end + SLICE]]).any():
                    end = min(end + SLICE, len(data))
                end += int(met.argmax()) if end < len(data) else 0
                if end - p > SHORT:
                    out.append(mix64(np.array([_long_hash(data[p:end].tobytes().translate(LOWER))], np.uint64)))
                    p = end
                    continue
        out.append(_words(data[p:end], np.array([0, end - p]))[1])
        p = end
    return np.concatenate(out)


def shingle_sets(batch: pa.RecordBatch, column: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes on end, and the offsets of the rows (fewer than 65,536).

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r, A-Z lower-cased; a text of fewer than ``words`` words
    has one shingle, its whole sequence, and none without a word. A long text is one row; it is read in pieces.
    """
    data, at = utf8(batch, column)
    rows = len(at) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    factors = [np.uint64(f) for f in np.random.default_rng(202).integers(1, 1 << 63, words, dtype=np.uint64) | np.uint64(1)]
    if rows == 1 and len(data) > SLICE:
        word = _long_words(data)
        if len(word) >= words:
            key = np.zeros(len(word) - words + 1, np.uint64)
            for c in range(0, len(key), SLICE):
                some = key[c : c + SLICE]
                for j in range(words):
                    some += word[c + j : c + j + len(some)] * factors[j]
                mix64(some)
            del word
            key.sort()
            new = np.empty(len(key), bool)
            new[0] = True
            np.not_equal(key[1:], key[:-1], out=new[1:])
            if not new.all():
                key = key[new]
            return key, np.array([0, len(key)])
        owner = np.zeros(len(word), np.int64)
    else:
        begin, word = _words(data, at)
        owner = np.searchsorted(at, begin, side="right") - 1
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    counts = np.bincount(owner, minlength=rows)
    first = np.r_[0, np.cumsum(counts)[:-1]]
    parts_row, parts = [], []
    if len(word) >= words:
        full = np.flatnonzero(owner[: len(owner) - words + 1] == owner[words - 1 :])
        h = np.zeros(len(full), np.uint64)
        for j in range(words):
            h += word[full + j] * factors[j]
        parts.append(h)
        parts_row.append(owner[full])
    for m in range(1, words):
        short = np.flatnonzero(counts == m)
        h = np.full(len(short), m, np.uint64)
        for j in range(m):
            h += word[first[short] + j] * factors[j]
        parts.append(h)
        parts_row.append(short)
    key, row = mix64(np.concatenate(parts)), np.concatenate(parts_row).astype(np.uint16)
    order = np.argsort(key)
    order = order[np.argsort(row[order], kind="stable")]
    key, row = key[order], row[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
    key, row = key[new], row[new]
    return key, np.r_[0, np.cumsum(np.bincount(row, minlength=rows))]


def _mix32(x: np.ndarray, spare: np.ndarray, a: np.uint32, b: np.uint32) -> None:
    for shift, factor in ((16, a), (13, b)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, factor, out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


def signatures(sets: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """(rows with a shingle, size): the circulant MinHash coordinates."""
    starts = at[:-1][np.diff(at) > 0]
    if len(starts) == 1 and len(sets) > SLICE:
        parts = (sets[c : c + SLICE] for c in range(0, len(sets), SLICE))
        return np.minimum.reduce([signatures(p, np.array([0, len(p)]), size) for p in parts])
    first = (sets & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    first ^= (sets >> np.uint64(32)).astype(np.uint32)
    spare, x = np.empty_like(first), np.empty_like(first)
    _mix32(first, spare, M32A, M32B)  # the first permutation
    out = np.empty((len(starts), size), np.uint32)
    for k in range(size):
        np.add(first, np.uint32(k), out=x)  # the circular shift
        _mix32(x, spare, np.uint32(0x7FEB352D), np.uint32(0x846CA68B))  # the second permutation
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _order_free(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(2, sets): two sums over each set's scrambled shingles, 128 bits that don't depend on the order."""
    if len(starts) == 1 and len(sets) > SLICE:
        return np.sum([_order_free(sets[c : c + SLICE], starts) for c in range(0, len(sets), SLICE)], axis=0, dtype=np.uint64)
    return np.array([np.add.reduceat(mix64(sets * np.uint64(0xD1342543DE82EF95)), starts), np.add.reduceat(mix64(sets ^ np.uint64(0xA0761D6478BD642F)), starts)])


def parity_sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, SKETCH_WORDS): a bit is the parity of the number of a set's shingles that fall on it.

    Two sketches differ in no more bits than their sets in shingles: shingles of both fall on the same bit and cancel out.
    """
    rows = len(at) - 1
    if rows == 1 and len(sets) > SLICE:
        return np.bitwise_xor.reduce([parity_sketches(p := sets[c : c + SLICE], np.array([0, len(p)])) for c in range(0, len(sets), SLICE)])
    out = np.zeros(rows * SKETCH_WORDS, np.uint64)
    if len(sets):
        width = np.uint64(SKETCH_WORDS.bit_length() - 1)
        place = np.repeat(np.arange(rows), np.diff(at)) * SKETCH_WORDS + (sets >> (np.uint64(64) - width)).astype(np.int64)  # ascends as the sets do
        bit = np.uint64(1) << (sets >> (np.uint64(58) - width) & np.uint64(63))
        first = np.r_[0, np.flatnonzero(np.diff(place)) + 1]
        out[place[first]] = np.bitwise_xor.reduceat(bit, first)
    return out.reshape(rows, SKETCH_WORDS)


def fingerprints(documents: DataFrame, words: int, bands: int) -> DataFrame:
    """(key, h, n, fp1, fp2, bands) of (key, h, text): set size, an order-free 128-bit fingerprint of the set, and one hash for each band."""
    kind = documents.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, at = shingle_sets(part, "text", words)
                n = np.diff(at)
                some = n > 0
                fp = np.zeros((2, len(n)), np.uint64)
                hashes = np.zeros((0, bands), np.uint64)
                if len(sets):
                    starts = at[:-1][some]
                    fp[:, some] = _order_free(sets, starts)
                    sig = signatures(sets, at, bands * ROWS_PER_BAND).astype(np.uint64).reshape(len(starts), bands, ROWS_PER_BAND)
                    hashes = np.tile(np.arange(bands, dtype=np.uint64), (len(starts), 1))
                    for j in range(ROWS_PER_BAND):
                        hashes = mix64(hashes * BASE + sig[:, :, j])
                offsets = np.r_[0, np.cumsum(some * bands)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [held_by(part, "key"), held_by(part, "h"), pa.array(n), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), lists], ["key", "h", "n", "fp1", "fp2", "bands"]
                )

    return documents.mapInArrow(run, f"key {kind}, h long, n long, fp1 long, fp2 long, bands array<long>")


def _sets_of(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, n, sketch, shingles) of the wanted (node, key, h), read from the documents again."""
    few = wanted.count()
    met = documents.join(F.broadcast(wanted) if few <= BROADCAST_IDS else wanted, ["key", "h"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, at = shingle_sets(part, "text", words)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                bits = pa.array(parity_sketches(sets, at).ravel().view(np.int64))
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(at), dtype=np.int32) * SKETCH_WORDS), bits)
                yield pa.RecordBatch.from_arrays([held_by(part, "node"), pa.array(np.diff(at)), sketches, lists], ["node", "n", "sketch", "shingles"])

    sets = materialize(met.mapInArrow(run, "node long, n long, sketch array<long>, shingles array<long>"))
    if sets.count() > few:  # rows that repeat an id and its text give the same set: one is enough
        sets = materialize(sets.dropDuplicates(["node"]))
    return sets


def _alike(common: Column, n: Column, m: Column, percent: int) -> Column:
    return common * 100 >= (n + m - common) * percent


def _may_be_alike(differing: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles, of which at least so many are in one only, can be alike: what fails is not."""
    return _alike((n + m - F.greatest(differing, F.abs(n - m))) / 2, n, m, percent)


def _only_of(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in the written table ``wanted``; few keys are broadcast, so that other rows are not shuffled."""
    ids = wanted.select(key).distinct()
    return rows.join(F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids, key, "left_semi")


def _possible(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stars (a, b) but for those that their sketches rule out: no alike pair is lost, and no full set is moved."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")).join(stars.select("b").distinct(), "b", "left_semi")
    met = hot_join(stars.join(left, "a"), right, ["b"], F.col("a"), hot_keys(stars, "b"))
    differing = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return met.where(_may_be_alike(differing, F.col("na"), F.col("nb"), percent)).select("a", "b")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are alike; b may be a hub of many pairs."""
    left = _only_of(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), pairs, "a")
    right = _only_of(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), pairs, "b")
    met = hot_join(pairs.join(left, "a"), right, ["b"], F.col("a"), hot_keys(pairs, "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    return met.where(_alike(common, F.size("sa"), F.size("sb"), percent)).select("a", "b")


def _star_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join all that the alike ones among the stars (node a, hub b) join.

    A node is compared with its smallest hub first, and with its other hubs only where that has left it in another component.
    """
    own = materialize(stars.groupBy("a").agg(F.min("b").alias("own")))
    links = materialize(_confirm(own.withColumnRenamed("own", "b"), sets, percent))
    labels = components(links)
    named, other = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    rest = stars.join(own, "a").where("b <> own").join(named, "a", "left").join(other, "b", "left")
    rest = materialize(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    return links if rest.isEmpty() else materialize(links.unionByName(_confirm(rest, sets, percent)))


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept, text_hash, stays) of every row.

    Rows are linked when 100 * common shingles >= ``percent`` * all shingles of both; a component's id is the smallest key in
    it, ``kept`` marks the rows with that key. ``stays`` marks one text of each component: of the rows with the smallest key those
    whose text has the smallest ``text_hash`` (64 bits), so it also decides between different texts that share a key.
    Rows without words have no shingle and are linked with nothing. A null key is linked with nothing: its component is null,
    it is kept and stays. Repeated rows and equal texts are one class: they share the component, each row is returned.
    Empty tables give empty results; further columns are ignored.

    Equal sets are grouped before anything else, so groups of copies cost one row. In each bucket of a band all
    members are compared with the smallest (a star, not all pairs). Members of buckets that then still hold several
    components are compared block by block within their bucket: a task takes blocks of bounded rows and shingles, counts
    common shingles in matrices, and returns only links that join components. Before full sets are moved, short sketches
    bound from below how many shingles two sets don't share, and leave out what that rules out. So no link between
    candidates is lost, and what is returned grows with the members, not with their pairs.
    """
    base = only(documents, key, text).toDF("key", "text").select("key", F.xxhash64("text").alias("h"), "text")
    bands = bands_for(percent)
    prints = materialize(fingerprints(base, words, bands))
    classes = prints.where("n > 0 and key is not null").groupBy("fp1", "fp2").agg(
        F.min(F.struct("key", "h")).alias("first"), F.max("n").alias("n"), F.count("*").alias("rows"), F.any_value("bands").alias("bands")
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    buckets = classes.select("node", "n", F.explode("bands").alias("band"))
    hubs = materialize(buckets.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1"))
    members = materialize(hot_join(buckets, hubs.select("band", "hub"), ["band"], F.col("node"), hot_of(hubs, "size", "band")))
    wanted = members.select("node").distinct().join(classes.select("node", "first.key", "first.h"), "node")
    sets = _sets_of(base, materialize(wanted), words)
    stars = materialize(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    possible = materialize(_possible(stars, sets, percent))
    labels = _settle(components(_star_links(possible, sets, percent)), members.select("band", "node", "n"), sets, percent)
    labels = materialize(classes.select("node", "first").join(labels, "node"))
    leaders = labels.groupBy("component").agg(F.min("first").alias("leader"))
    named = hot_join(labels.select("node", "component"), leaders, ["component"], F.col("node"), hot_keys(labels, "component")).select("node", "leader")
    of_class = classes.select("fp1", "fp2", "node", "first").join(named, "node", "left").select("fp1", "fp2", F.coalesce("leader", "first").alias("leader"))
    rows = prints.select("key", "h", "n", "fp1", "fp2")
    out = hot_join(rows, of_class, ["fp1", "fp2"], F.struct("key", "h"), hot_of(classes, "rows", "fp1", "fp2"), "left")
    leader = F.when(F.col("key").isNotNull() & (F.col("n") > 0), F.col("leader"))
    component = F.when(F.col("key").isNotNull(), F.coalesce(leader["key"], F.col("key")))
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"),
        F.col("h").alias("text_hash"), F.coalesce((leader["key"] == F.col("key")) & (leader["h"] == F.col("h")), F.lit(True)).alias("stays"),
    )


def common_counts(rows: np.ndarray, shingles: np.ndarray, m: int) -> np.ndarray:
    """(m, m) numbers of common shingles (above the diagonal) of m sets given as (row, shingle) pairs.

    Shingles of a few rows are counted pair by pair along the sorted list, those of many rows by products of 0/1 matrices.
    """
    order = np.lexsort((rows, shingles))
    rows, shingles = rows[order].astype(np.int64), shingles[order]
    new = np.r_[True, shingles[1:] != shingles[:-1]]
    kind = np.cumsum(new) - 1
    size = np.bincount(kind)[kind]
    out = np.zeros(m * m, np.float32)
    few = 16
    r, k = rows[(size > 1) & (size <= few)], kind[(size > 1) & (size <= few)]
    for step in range(1, few):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        out += np.bincount(r[same] * m + r[same + step], minlength=m * m).astype(np.float32)
    out = out.reshape(m, m)
    r, k = rows[size > few], kind[size > few]
    if len(r):
        columns = np.unique(k, return_inverse=True)[1]
        width = max(1, (2 << 20) // m)
        for begin in range(0, int(columns.max()) + 1, width):
            part = (columns >= begin) & (columns < begin + width)
            x = np.zeros((m, min(width, int(columns.max()) + 1 - begin)), np.float32)
            x[r[part], columns[part] - begin] = 1
            out += x @ x.T
    return out


def joining_pairs(nodes: np.ndarray, labels: np.ndarray, n: np.ndarray, flat: np.ndarray, at: np.ndarray, lower: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """The alike pairs of different labels among a few sets, as few as join what they join; only pairs across ``lower``, if given."""
    common = common_counts(np.repeat(np.arange(len(n)), np.diff(at)), flat, len(n)).astype(np.int64)
    alike = common * 100 >= (n[:, None] + n[None, :] - common) * percent
    alike &= labels[:, None] != labels[None, :]
    if lower is not None:
        alike &= lower[:, None] != lower[None, :]
    parent = {c: c for c in labels.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(alike)), strict=True):
        x, y = root(int(labels[i])), root(int(labels[j]))
        if x != y:
            parent[y] = x
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _compared(table: pa.Table) -> Iterator[np.ndarray]:
    """The rows of each comparison (band, lo, hi) of a table that holds several components."""
    component, *keys = (table[c].to_numpy() for c in ("component", "band", "lo", "hi"))
    order = np.lexsort(keys[::-1])
    keys = np.stack(keys)[:, order]
    cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, len(order)]
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = order[begin:end]
        if (component[own] != component[own[0]]).any():
            yield own


def with_possible_partner(sketches: np.ndarray, labels: np.ndarray, n: np.ndarray, lower: np.ndarray | None, percent: int) -> np.ndarray:
    """Which of a few sets may be alike with one of another label, by their sketches; only across ``lower``, if given."""
    rows = np.arange(len(n)) if lower is None else np.flatnonzero(lower)
    columns = rows if lower is None else np.flatnonzero(~lower)
    out = np.zeros(len(n), bool)
    words = np.ascontiguousarray(sketches[columns].T)
    for begin in range(0, len(rows), 256):
        some = rows[begin : begin + 256]
        differing = np.zeros((len(some), len(columns)), np.int64)
        for k in range(SKETCH_WORDS):
            differing += np.bitwise_count(sketches[some, k][:, None] ^ words[k])
        both, apart = n[some][:, None] + n[columns], np.abs(n[some][:, None] - n[columns])
        most = both - np.maximum(differing, apart)  # twice the shingles in common, at most
        may = (most * 100 >= (2 * both - most) * percent) & (labels[some][:, None] != labels[columns])
        out[some] |= may.any(axis=1)
        out[columns] |= may.any(axis=0)
    return out


def _thinning(percent: int):  # noqa: ANN202
    """The kernel of many comparisons of sketches: the members that they leave to be compared on full sets."""

    def run(table: pa.Table) -> pa.Table:
        lo, hi, block, component, n = (table[c].to_numpy() for c in ("lo", "hi", "block", "component", "n"))
        sketches = np.asarray(table["sketch"].combine_chunks().flatten()).view(np.uint64).reshape(-1, SKETCH_WORDS)
        left = np.zeros(len(n), bool)
        for own in _compared(table):
            lower = block[own] == lo[own[0]] if lo[own[0]] != hi[own[0]] else None
            left[own] = with_possible_partner(sketches[own], component[own], n[own], lower, percent)
        return table.select(["band", "node", "n", "component"]).filter(pa.array(left))

    return run


def _joining(percent: int):  # noqa: ANN202
    """The kernel of many comparisons (band, lo, hi) of one or two blocks."""

    def run(table: pa.Table) -> pa.Table:
        lo, hi, block, node, component, n = (table[c].to_numpy() for c in ("lo", "hi", "block", "node", "component", "n"))
        lists = table["shingles"].combine_chunks()
        ends, flat = np.asarray(lists.offsets, np.int64), np.asarray(lists.values)
        pairs: list[tuple[int, int]] = []
        for own in _compared(table):
            at = np.r_[0, np.cumsum(ends[own + 1] - ends[own])]
            sets = np.concatenate([flat[ends[i] : ends[i + 1]] for i in own.tolist()])
            lower = block[own] == lo[own[0]] if lo[own[0]] != hi[own[0]] else None
            pairs += joining_pairs(node[own], component[own], n[own], sets, at, lower, percent)
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _comparisons(labelled: DataFrame, most_rows: int, most_shingles: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(band, lo, hi, block, node, component, n) of all comparisons of two blocks within the buckets (band, node, n, component) of several components.

    A block holds so many rows and shingles, about. The second table has each bucket's size, blocks and shingles; both are None if there are none.
    """
    unsettled = labelled.groupBy("band").agg(
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("size"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("who1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("who2")
    )
    unsettled = unsettled.where("c1 <> c2").groupBy("who1", "who2", "size", "total").agg(F.min("band").alias("band"))  # buckets of the same members are compared once
    blocks = F.ceil(F.col("size") / most_rows)
    if most_shingles:
        blocks = F.greatest(blocks, F.ceil(F.col("total") / most_shingles))
    unsettled = materialize(unsettled.select("band", "size", blocks.cast("int").alias("blocks"), "total"))
    if unsettled.isEmpty():
        return None, None
    active = hot_join(labelled, unsettled.select("band", "blocks"), ["band"], F.col("node"), hot_of(unsettled, "size", "band"))
    rows = active.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = rows.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "component", "n")
    return materialize(keyed), unsettled


def _tasks(work: int, most: int) -> Column:
    """Deals comparisons (band, lo, hi) to tasks of so much work each, about."""
    return F.pmod(F.xxhash64("band", "lo", "hi"), F.lit(max(1, -(-int(work) // most)))).alias("task")


def _settle(labels: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The labels after all links between members of one bucket that the stars have left in different components.

    Sketches are compared first; full sets are moved only for members that may be alike with one of another component.
    """
    labelled = materialize(members.join(labels, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component")))
    keyed, unsettled = _comparisons(labelled, SKETCH_ROWS)
    if keyed is None:
        return labels
    task = _tasks(unsettled.agg(F.sum(F.col("blocks") * F.col("size"))).first()[0], TASK_SKETCHES)
    thinned = keyed.join(sets.select("node", "sketch"), "node").groupBy(task).applyInArrow(_thinning(percent), "band long, node long, n long, component long")
    keyed, unsettled = _comparisons(materialize(thinned.distinct()), BLOCK_ROWS, BLOCK_SHINGLES)
    if keyed is None:
        return labels
    task = _tasks(unsettled.agg(F.sum(F.col("blocks") * F.col("total"))).first()[0], TASK_SHINGLES)
    paired = keyed.join(_only_of(sets.select("node", "shingles"), keyed, "node"), "node")
    found = materialize(paired.groupBy(task).applyInArrow(_joining(percent), "a long, b long"))
    if found.isEmpty():
        return labels
    named = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    other = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = found.join(named, "a", "left").join(other, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("to"))
    lone = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    known = labels.unionByName(lone.withColumn("component", F.col("node")))
    return materialize(hot_join(known, joined, ["component"], F.col("node"), hot_keys(known, "component"), "left").select("node", F.coalesce("to", "component").alias("component")))
