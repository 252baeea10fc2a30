"""Repeated passages from enhanced suffix arrays and their common-prefix interval trees.

Every window of ``least`` bytes belongs to the segment of its anchor: the k-gram in it with the smallest
hash. Equal windows have equal anchors, so only segments that share an anchor's hash can repeat each other, and
each window is looked at once. A suffix array with common-prefix lengths over the segments of an anchor
is scanned with a stack; its intervals of common prefix ``least`` and more whose suffixes have different left
neighbours are the maximal repeats, with all their occurrences.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, held_by, hot_join, hot_of, materialize, mix64, only, release, settled, slices, utf8, written

LEAST = 200
GRAM = 32
#: Bytes of contexts that one kernel call takes, about, and distinct contexts of one anchor that stay together.
KERNEL_BYTES = 1 << 19
CHUNK = 4096
#: Up to this many text keys (16 bytes each) are broadcast to prune the documents before they are shuffled.
BROADCAST_KEYS = 500_000
#: Width of the first ranks: seven symbols of nine bits make a key.
FIRST = 7
PLACE = np.uint64((1 << 28) - 1)
#: Odd base of the rolling hash that places anchors: equal hashes only bring segments together, they decide nothing.
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


# --- the kernel -------------------------------------------------------------------------------


def suffix_array(texts: list[bytes], groups: np.ndarray, starts: list[np.ndarray] | None = None, least: int = 1) -> dict:
    """Sorted suffixes of many short texts by (group, suffix), with common-prefix lengths; suffixes end with their text.

    ``starts`` limits the suffixes to given positions of each text. Ranks of prefixes of 7, 21, 63 ... bytes
    come from sorting triples of ranks (pairs where three don't fit 64 bits); the same ranks give the common
    prefixes of neighbours. Common prefixes shorter than ``least`` may be given as 0.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    width = sizes + FIRST
    base = np.r_[0, np.cumsum(width)]
    symbols = np.zeros(int(base[-1]) + FIRST, np.uint16)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    at = np.arange(len(flat)) + np.repeat(base[:-1] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    symbols[at] = flat
    symbols[at] += np.uint16(1)
    n = int(base[-1])
    stop = np.repeat((base[:-1] + sizes).astype(np.int32), width)  # where each position's text ends: all zeros from there
    key = np.zeros(n, np.uint64)
    for j in range(FIRST):
        key <<= np.uint64(9)
        key |= symbols[j : j + n]
    place = np.arange(n, dtype=np.int32)
    ranks, span, longest = [], FIRST, int(sizes.max(initial=0))
    while True:
        order = np.argsort(key)
        key = key[order]
        step = np.empty(n, np.int32)
        step[:1] = 0
        np.not_equal(key[1:], key[:-1], out=step[1:], casting="unsafe")
        rank = np.empty(n, np.uint32)
        rank[order] = np.cumsum(step, dtype=np.uint32)
        ranks.append((span, rank))
        if span >= longest or not n:
            break
        bits = np.uint64(max(1, int(rank.max()).bit_length()))
        key = rank.astype(np.uint64)
        for k in (1, 2) if 3 * bits <= 64 else (1,):
            key <<= bits
            key |= rank[np.minimum(place + k * span, stop)]
        span *= 3 if 3 * bits <= 64 else 2
    if starts is None:
        starts = [np.arange(s) for s in sizes]
    count = np.array([len(s) for s in starts], np.int64)
    text = np.repeat(np.arange(len(texts)), count)
    offset = np.concatenate(starts).astype(np.int64) if starts else np.zeros(0, np.int64)
    pos = base[:-1][text] + offset
    order = np.argsort((groups[text].astype(np.uint64) << np.uint64(32)) | ranks[-1][1][pos])
    pos, text, offset = pos[order], text[order], offset[order]
    group = groups[text]
    common = np.zeros(max(0, len(pos) - 1), np.int64)
    shared = group[1:] == group[:-1]
    near = max([k for k in ranks if k[0] <= least], default=None, key=lambda k: k[0])
    if near is not None:
        shared &= near[1][pos[1:]] == near[1][pos[:-1]]
    some = np.flatnonzero(shared)
    a, b = pos[some], pos[some + 1]
    end_a, end_b = stop[a].astype(np.int64), stop[b].astype(np.int64)
    reach = np.minimum(end_a - a, end_b - b)
    found = np.zeros(len(some), np.int64)
    for span, rank in reversed(ranks):
        for _ in range(2):  # at most two spans of a level fit below the next level's
            same = span * (rank[np.minimum(a, end_a)] == rank[np.minimum(b, end_b)]) * (found < reach)
            found += same
            a, b = np.minimum(a + same, end_a), np.minimum(b + same, end_b)
    for _ in range(FIRST - 1):
        same = (symbols[a] == symbols[b]) & (symbols[a] > 0)
        found += same
        a, b = a + same, b + same
    common[some] = np.minimum(found, reach)
    before = np.where(offset > 0, symbols[np.maximum(pos - 1, 0)].astype(np.int64), -1 - np.arange(len(pos)))
    return {"text": text, "offset": offset, "lcp": np.r_[0, common].astype(np.int64)[: len(pos)], "left": before}


def maximal_repeats(array: dict, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of the common-prefix tree with length ``least`` and more and diverse left ends.

    The interval is a range of the suffix array: all occurrences of one maximal repeat. Runs of neighbours with long
    common prefixes whose left symbols are all equal are passed over: whatever repeats there extends to the left.
    A suffix at the beginning of its text has a left end of its own.
    """
    lcp, left = array["lcp"], array["left"]
    n = len(lcp)
    if n < 2:
        return
    long = lcp >= least
    edges = np.flatnonzero(np.diff(np.r_[False, long[1:], False].astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]  # a run is the suffixes begin..end
    changes = np.r_[0, np.cumsum(left[1:] != left[:-1])]
    diverse = changes[ends] > changes[begins]
    for lo, hi in zip(begins[diverse].tolist(), ends[diverse].tolist(), strict=True):
        stack: list[tuple[int, int]] = []  # (length, first)
        heights = lcp[lo + 1 : hi + 1].tolist() + [0]
        for i, h in enumerate(heights, lo + 1):
            first = i - 1
            while stack and stack[-1][0] > h:
                length, first = stack.pop()
                if changes[i - 1] > changes[first]:
                    yield length, first, i - 1
            if h >= least and (not stack or stack[-1][0] < h):
                stack.append((h, first))


def merge_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal runs."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > end[:-1]]
    return begin[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def repeats_in_contexts(texts: list[bytes], groups: np.ndarray, copies: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context the spans that a maximal repeat of its group covers; a context with copies repeats as a whole."""
    starts = [np.arange(len(t) - least + 1) for t in texts]
    array = suffix_array(texts, groups, starts, least)
    found_text, found_begin, found_end = [], [], []
    for length, first, last in maximal_repeats(array, least):
        found_text.append(array["text"][first : last + 1])
        found_begin.append(array["offset"][first : last + 1])
        found_end.append(array["offset"][first : last + 1] + length)
    whole = np.flatnonzero(copies > 1)
    text = np.concatenate([*found_text, whole]).astype(np.int64)
    begin = np.concatenate([*found_begin, np.zeros(len(whole), np.int64)])
    end = np.concatenate([*found_end, np.array([len(texts[i]) for i in whole], np.int64)])
    # spans of all contexts at once: shifted apart, merged, shifted back
    shift = text * (1 << 32)
    b, e = merge_spans(begin + shift, end + shift)
    owner = b >> 32
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(b[i:j] & 0xFFFFFFFF, e[i:j] & 0xFFFFFFFF) for i, j in zip(cut[:-1], cut[1:], strict=True)]


# --- segments ---------------------------------------------------------------------------------


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(data: np.ndarray, at: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor hash, context hash) of the segments of texts on end; windows by their start in the row."""
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none, none, none
    values = np.random.default_rng(303).integers(1, 1 << 63, 256, dtype=np.uint64)
    up, down = _powers(1 << max(20, (len(data) - 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    sums[1:] = values[data]
    sums[1:] *= up[: len(data)]
    np.cumsum(sums, out=sums)
    grams = sums[gram:] - sums[:-gram]
    grams *= down[: len(grams)]
    grams = mix64(grams)
    packed = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    low = _sliding_min(packed, least - gram + 1)
    row_end = np.repeat(at[1:], np.diff(at))
    begin = np.arange(len(low))
    windows = np.flatnonzero(begin + least <= row_end[: len(low)])
    if not len(windows):
        return none, none, none, none, none
    anchor = (low[windows] & PLACE).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)])
    first, last = windows[cut], windows[np.r_[cut[1:] - 1, len(windows) - 1]]
    anchor = anchor[cut]
    row = np.searchsorted(at, first, side="right") - 1
    context = (sums[last + least] - sums[first]) * down[first]
    context ^= (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    return row, first - at[row], last - at[row], grams[anchor].view(np.int64), mix64(context).view(np.int64)


def _with_key(documents: DataFrame, text: str) -> DataFrame:
    """The documents with their text's key (d, n), 128 bits: a 64-bit hash, and the length in bytes over a 32-bit hash of another kind."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return documents.withColumn("d", F.xxhash64(raw)).withColumn("n", F.shiftleft(F.octet_length(raw).cast("long"), 32).bitwiseOR(F.hash(raw).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))


def pieces(part: pa.RecordBatch, text: str, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, row offsets, position in the row) of a slice: as it is, or a long text in pieces that overlap so that each window lies in one."""
    data, at = utf8(part, text)
    if part.num_rows > 1 or len(data) <= 2 * SLICE:
        yield data, at, 0
        return
    for begin in range(0, len(data) - least + 1, SLICE):
        some = data[begin : begin + SLICE + least - 1]
        yield some, np.array([0, len(some)]), begin


def repeat_spans(documents: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """(d, n, begins, ends): for each distinct text with repeats the maximal runs of bytes they cover.

    ``documents`` has a text column and its key (d, n) from :func:`_with_key`; null counts as the empty
    text. A byte is covered if a string of ``least`` bytes over it also starts anywhere else, in the same text or
    another row's. Texts shorter than ``least`` have no window. Spans are judged on the input, overlaps count.

    Stages: segments of all texts (narrow rows, written once); anchors seen more than once; their segments by
    context, equal contexts counted (so groups of copies are one row); suffix arrays over the distinct contexts of an
    anchor, many anchors a task. An anchor of more than CHUNK distinct contexts is dealt over chunks; windows that
    no other of their chunk equals are then compared across chunks by 128-bit digests, one narrow row each.
    """
    before = written()
    rows, shared, sized = _segments_of(documents, least, text)
    asked = materialize(sized.where("m > 1"))
    spans = materialize(_scan(_contexts(rows, asked, least, text), least))
    # anchors of one context: all its windows are in every copy
    single = sized.where("m = 1").select(
        "anchor", "context", F.array(F.lit(0).cast("long")).alias("begins"), F.array((F.col("last") - F.col("first") + least).cast("long")).alias("ends")
    )
    inside = spans.unionByName(single).select("anchor", "context", F.explode(F.arrays_zip("begins", "ends")).alias("s"))
    part = shared.join(inside, ["anchor", "context"]).select("d", "n", (F.col("first") + F.col("s.begins")).alias("b"), (F.col("first") + F.col("s.ends")).alias("e"))
    spread = part.distinct().groupBy("d", "n").agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("s"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [merge_spans(np.array([x["b"] for x in s], np.int64), np.array([x["e"] for x in s], np.int64)) for s in held_by(batch, "s").to_pylist()]
            begins, ends = [b.tolist() for b, _ in pairs], [e.tolist() for _, e in pairs]
            yield pa.RecordBatch.from_arrays([held_by(batch, "d"), held_by(batch, "n"), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["d", "n", "begins", "ends"])

    return settled(spread.mapInArrow(merge, "d long, n long, begins array<long>, ends array<long>"), before)


def _segments_of(documents: DataFrame, least: int, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, shared, sized): the texts; their segments whose anchor is met more than once; the distinct contexts of these.

    A context has its copies counted, one place to cut it from, how many contexts its anchor has (m) and the chunk it is dealt to.
    """
    gram, before = min(GRAM, least), written()
    rows = documents.select("d", "n", text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                d, n = held_by(part, "d").to_numpy(), held_by(part, "n").to_numpy()
                for data, at, begin in pieces(part, text, least):
                    row, first, last, anchor, context = segments(data, at, least, gram)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(context), pa.array(d[row]), pa.array(n[row]), pa.array((first + begin).astype(np.int32)), pa.array((last + begin).astype(np.int32))],
                        ["anchor", "context", "d", "n", "first", "last"],
                    )

    schema = "anchor long, context long, d long, n long, first int, last int"
    found = materialize(rows.where(F.octet_length(text) >= least).mapInArrow(find, schema))
    again = materialize(found.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"))
    # an anchor inside a passage that many texts share is one key with a large part of the rows
    shared = settled(hot_join(found, again.select("anchor"), ["anchor"], F.struct("d", "first"), hot_of(again, "k", "anchor"), "left_semi"), before)
    kinds = shared.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min_by(F.struct("d", "n", "first", "last"), "d").alias("at"))
    kinds = materialize(kinds.select("anchor", "context", "copies", "at.*"))
    per_anchor = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("m")))
    sized = hot_join(kinds, per_anchor, ["anchor"], F.col("context"), hot_of(per_anchor, "m", "anchor"))
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    return rows, shared, sized.withColumn("chunks", chunks).withColumn("chunk", F.pmod("context", "chunks").cast("int"))


def _texts(rows: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """One row (d, n, text) for each wanted key; ``wanted`` is distinct."""
    keys = wanted.select("d", "n")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return rows.join(keys, ["d", "n"], "left_semi").dropDuplicates(["d", "n"])


def _contexts(rows: DataFrame, asked: DataFrame, least: int, text: str) -> DataFrame:
    """(anchor, context, copies, chunk, chunks, bytes): the bytes of the asked-for contexts, cut from their texts."""
    places = asked.groupBy("d", "n").agg(F.collect_list(F.struct("anchor", "context", "copies", "chunk", "chunks", "first", "last")).alias("places"))
    places = materialize(places)
    met = _texts(rows, places, text).join(places, ["d", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor", "context", "copies", "chunk", "chunks")
        for batch in batches:
            for part in slices(batch, text, SLICE):
                data, at = utf8(part, text)
                whole, out = memoryview(data), {k: [] for k in (*names, "bytes")}
                for begin, places in zip(at[:-1].tolist(), held_by(part, "places").to_pylist(), strict=True):
                    for p in places:
                        for k in names:
                            out[k].append(p[k])
                        out["bytes"].append(bytes(whole[begin + p["first"] : begin + p["last"] + least]))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return materialize(met.select(text, "places").mapInArrow(cut, "anchor long, context long, copies long, chunk int, chunks int, bytes binary"))


def _group_numbers(table: pa.Table) -> np.ndarray:
    """A number for each row, one for each (anchor, chunk)."""
    keys = table["anchor"].to_numpy().astype(np.int64), table["chunk"].to_numpy().astype(np.int64)
    order = np.lexsort(keys)
    new = np.r_[True, (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])]
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(new)
    return groups


def _scan(contexts: DataFrame, least: int) -> DataFrame:
    """(anchor, context, begins, ends): the repeats within each context, from the suffix arrays of the (anchor, chunk) groups."""
    total = contexts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(1, -(-int(total) // KERNEL_BYTES))

    def kernel(table: pa.Table) -> pa.Table:
        names, texts, groups = table.select(["anchor", "context"]), table["bytes"].to_pylist(), _group_numbers(table)
        pairs = repeats_in_contexts(texts, groups, table["copies"].to_numpy(), least)
        loose, seen = [], set()
        for t, group, chunks, (b, e) in zip(texts, groups.tolist(), table["chunks"].to_pylist(), pairs, strict=True):
            digests = []
            if chunks > 1:  # windows that nothing in this chunk equals, and one (w = -1) of each kind that something does
                open_ = np.ones(len(t) - least + 1, bool)
                for i, j in zip(b.tolist(), e.tolist(), strict=True):
                    open_[i : j - least + 1] = False
                for w, lone in enumerate(open_.tolist()):
                    digest = hashlib.blake2b(t[w : w + least], digest_size=16).digest()
                    if lone or (group, digest) not in seen:
                        digests.append({"w": w if lone else -1, "digest": digest})
                        seen.add((group, digest))
            loose.append(digests)
        kind = pa.list_(pa.struct([("w", pa.int32()), ("digest", pa.binary())]))
        ints = pa.list_(pa.int64())
        return pa.Table.from_arrays(
            [*names.columns, pa.array([b.tolist() for b, _ in pairs], ints), pa.array([e.tolist() for _, e in pairs], ints), pa.array(loose, kind)],
            ["anchor", "context", "begins", "ends", "loose"],
        )

    bucket = F.pmod(F.xxhash64("anchor", "chunk"), F.lit(buckets)).alias("bucket")
    spans = contexts.groupBy(bucket).applyInArrow(kernel, "anchor long, context long, begins array<long>, ends array<long>, loose array<struct<w:int,digest:binary>>")
    if contexts.where("chunks > 1").isEmpty():
        return spans.drop("loose")
    spans = materialize(spans)
    # across chunks: equal loose windows
    loose = spans.select("anchor", "context", F.explode("loose").alias("x")).select("anchor", "context", "x.w", "x.digest")
    equal = loose.groupBy("anchor", "digest").agg(F.count("*").alias("k")).where("k > 1").select("anchor", "digest")
    more = loose.where("w >= 0").join(equal, ["anchor", "digest"], "left_semi").select("anchor", "context", F.array(F.col("w").cast("long")).alias("begins"), F.array((F.col("w") + least).cast("long")).alias("ends"))
    return spans.drop("loose").unionByName(more)


# --- repeat groups ------------------------------------------------------------------------------


def repeat_groups(documents: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(group_id, length, key, begin): the groups of repeated strings of ``least`` bytes and more, one row for each occurrence.

    ``group_id`` names a repeated string (128 bits, in hex), a string is one group, and all its occurrences in all
    rows are in it: copies of a row, rows that share a key and rows without one included. Groups are the maximal repeats
    within the segments of an anchor, whose contexts are at most 2 * ``least`` bytes long, about: a longer repeat gives a group
    for each of its segments. Anchors of more than CHUNK distinct contexts give a group for each of their repeated windows
    of ``least`` bytes. Null texts, short texts and empty tables have no groups.
    """
    spark, before = documents.sparkSession, written()
    base = _with_key(only(documents, key, text), text)
    keys = materialize(base.select(key, "d", "n"))
    start = written()  # each table goes when the next ones are made of it
    rows, shared, sized = _segments_of(base.select("d", "n", text), least, text)
    made = start + 1  # shared stays
    sized = settled(sized, made)
    contexts = _contexts(rows, sized, least, text)
    release(spark, made, keep_last=True)
    kind = "g1 long, g2 long, length int, anchor long, context long, begin int"

    def digest(b: bytes) -> tuple[int, int]:
        return struct.unpack("<qq", hashlib.blake2b(b, digest_size=16).digest())

    def table_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["g1", "g2", "length", "anchor", "context", "begin"])

    def kernel(table: pa.Table) -> pa.Table:
        texts, copies = table["bytes"].to_pylist(), table["copies"].to_pylist()
        anchors, contexts = table["anchor"].to_pylist(), table["context"].to_pylist()
        array = suffix_array(texts, _group_numbers(table), [np.arange(len(t) - least + 1) for t in texts], least)
        found = [(*digest(t), len(t), anchors[i], contexts[i], 0) for i, t in enumerate(texts) if copies[i] > 1]
        for length, first, last in maximal_repeats(array, least):
            places = list(zip(array["text"][first : last + 1].tolist(), array["offset"][first : last + 1].tolist(), strict=True))
            i, o = places[0]
            name = digest(texts[i][o : o + length])  # a context with copies is there already as a whole
            found += [(*name, length, anchors[i], contexts[i], o) for i, o in places if o or copies[i] == 1 or length < len(texts[i])]
        return pa.Table.from_batches([table_of(found)])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, context, t in zip(*(held_by(batch, c).to_pylist() for c in ("anchor", "context", "bytes")), strict=True):
                yield table_of([(*digest(t[w : w + least]), least, anchor, context, w) for w in range(len(t) - least + 1)])

    total = contexts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-int(total) // KERNEL_BYTES)))).alias("bucket")
    found = contexts.where("chunks = 1").groupBy(bucket).applyInArrow(kernel, kind)
    many = contexts.where("chunks > 1")
    if not many.isEmpty():
        each = materialize(many.select("anchor", "context", "copies", "bytes").mapInArrow(windows, kind))
        counted = each.join(many.select("anchor", "context", "copies"), ["anchor", "context"])
        again = counted.groupBy("g1", "g2").agg(F.sum("copies").alias("k")).where("k > 1").select("g1", "g2")
        found = found.unionByName(each.join(again, ["g1", "g2"], "left_semi"))
    found = settled(found, made)
    # a window lies in one segment, so an occurrence comes once
    met = shared.distinct().join(found, ["anchor", "context"]).select("g1", "g2", "length", "d", "n", (F.col("first") + F.col("begin")).alias("begin"))
    out = settled(_joined(settled(met, start)), start)
    return settled(out.join(keys, ["d", "n"]).select(F.lower(F.hex("name")).alias("group_id"), "length", key, "begin"), before)


def _joined(found: DataFrame) -> DataFrame:
    """(name, length, d, n, begin) of (g1, g2, length, d, n, begin): the groups that overlap or touch in all of their occurrences, made one.

    Two groups have the same occurrences if these lie alike around the first one; that is compared by two hashes over all of them, so no
    group is collected. Around one first text, groups of the same occurrences are laid end to end; what is joined is a string that occurs wherever its
    first part does. Groups of many occurrences meet their one row over salts.
    """
    where, group = F.struct("d", "n", "begin"), ["g1", "g2"]
    firsts = materialize(found.groupBy(*group, "length").agg(F.min(where).alias("f"), F.count("*").alias("k")))
    hot = hot_of(firsts, "k", *group)
    place = [F.col("d"), F.col("n"), F.col("begin") - F.col("f.begin")]
    around = hot_join(found, firsts.select(*group, "f", "k"), group, F.struct("d", "n", "begin"), hot)
    alike = around.groupBy(*group).agg(F.bit_xor(F.xxhash64(*place)).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), *place)).alias("s2"))
    same = ["fd", "fn", "k", "s1", "s2"]
    laid = firsts.join(alike, group).select(*group, F.col("f.d").alias("fd"), F.col("f.n").alias("fn"), "k", "s1", "s2", F.col("f.begin").alias("at"), (F.col("f.begin") + F.col("length")).alias("end"))
    along = Window.partitionBy(*same).orderBy("at", F.desc("end"), *group)
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    laid = laid.withColumn("new", (F.col("at") > F.coalesce(reached, F.lit(-1))).cast("int")).withColumn("run", F.sum("new").over(along))
    whole = laid.groupBy(*same, "run").agg(F.min("at").alias("at"), (F.max("end") - F.min("at")).cast("int").alias("length"), F.min(F.struct("at", *group)).alias("g"))
    name = F.unhex(F.left(F.sha2(F.concat_ws("/", *same, "at", "length"), 256), F.lit(32)))
    whole = whole.select("g.g1", "g.g2", name.alias("name"), "length")
    out = hot_join(found.drop("length"), whole, group, F.struct("d", "n", "begin"), hot)
    return out.select("name", "length", "d", "n", "begin")


# --- what becomes of the documents --------------------------------------------------------------


def digest_removed(documents: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row, all repeated bytes removed.

    Null texts count as empty. Repeated rows repeat each other: texts of ``least`` bytes and more vanish from both.
    Null keys and rows that share a key are kept apart. Empty tables give empty results.
    """
    base = _with_key(only(documents, key, text), text)
    spans = repeat_spans(base.select("d", "n", text), least, text)
    met = _texts(base.select("d", "n", text), spans, text).join(spans, ["d", "n"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("d", "n", "n_removed", "n_spans", "kept_sha256")}
            for part in slices(batch, text, SLICE):
                data, at = utf8(part, text)
                whole = memoryview(data)
                columns = (held_by(part, c).to_pylist() for c in ("d", "n", "begins", "ends"))
                for i, (d, n, begins, ends) in enumerate(zip(*columns, strict=True)):
                    kept, h = int(at[i]), hashlib.sha256()
                    for b, e in zip(begins, ends, strict=True):
                        h.update(whole[kept : int(at[i]) + b])
                        kept = int(at[i]) + e
                    h.update(whole[kept : int(at[i + 1])])
                    for k, v in zip(out, (d, n, sum(ends) - sum(begins), len(begins), h.hexdigest()), strict=True):
                        out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    cleaned = met.select("d", "n", text, "begins", "ends").mapInArrow(remove, "d long, n long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    narrow = base.select(key, "d", "n", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("whole"))
    return narrow.join(cleaned, ["d", "n"], "left").select(
        key, F.shiftright("n", 32).alias("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


def remove_repeats(documents: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """The documents with repeated bytes cut from their texts; all columns and rows stay.

    A character that a cut would split goes as a whole. Texts without repeats, and nulls, are as they were.
    """
    names = documents.columns
    base = _with_key(documents.select(text), text)
    spans = repeat_spans(base, least, text)
    plain = documents.toDF(*(f"c{i}" for i in range(len(names))))
    at_name = f"c{names.index(text)}"
    keyed = _with_key(plain, at_name)
    met = keyed.join(spans, ["d", "n"], "left").select(*plain.columns, "begins", "ends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at_name, SLICE):
                texts = held_by(part, at_name).to_pylist()
                for i, (begins, ends) in enumerate(zip(held_by(part, "begins").to_pylist(), held_by(part, "ends").to_pylist(), strict=True)):
                    if begins:
                        raw, kept, last = texts[i].encode(), [], 0
                        for b, e in zip(begins, ends, strict=True):
                            kept.append(raw[last:b])
                            last = e
                        texts[i] = b"".join(x.decode("utf-8", "ignore").encode() for x in (*kept, raw[last:])).decode()
                arrays = [pa.array(texts, c.type) if name == at_name else c for name, c in zip(part.schema.names, part.columns, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: len(names)], part.schema.names[: len(names)])

    return met.mapInArrow(cut, plain.schema).toDF(*names)
