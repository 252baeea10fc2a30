"""Packing token sequences online in bounded space.

Each partition keeps a fixed number of open windows. A document goes to the window it fits best;
when none has room, the fullest is topped up with the document's first tokens and emitted, and the
rest goes on. What is left open when the partitions end is merged in rounds of groups.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_by, materialize, only, slices

CAPACITY = 2048
OPEN_WINDOWS = 16
#: Tasks whose leftovers one merge takes together.
FAN_IN = 64
#: Texts above this many characters are encoded in parts, cut before a space between two other characters,
#: where the splitting pattern of the byte-level vocabulary always cuts.
LONG_TEXT = 4 << 20


@lru_cache(maxsize=1)
def _plain(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids as the tokenizer file at ``path`` gives them without special tokens added.

    A byte-level vocabulary with ranks beside it (same name, ``.tiktoken``) is encoded through those,
    which gives equal ids several times faster; texts that spell a special token, and
    vocabularies without ranks, go through the file itself.
    """
    with open(path, "rb") as f:
        specials = [t["content"] for t in json.load(f).get("added_tokens", [])]
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    fast = None
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def whole(text: str) -> np.ndarray:
        if fast is None or any(s in text for s in specials):
            return np.array(_plain(path).encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    def encode(text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return whole(text)
        parts, begin = [], 0
        while begin < len(text):
            at = begin + LONG_TEXT
            while at < len(text) - 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()):
                at += 1
            at = len(text) if at >= len(text) - 1 else at
            parts.append(whole(text[begin:at]))
            begin = at
        return np.concatenate(parts)

    return encode


class Packer:
    """The open windows of one partition. ``emit`` gets (rows of a window) when it is full."""

    def __init__(self, capacity: int, windows: int, first_id: int, emit: Callable[[list[tuple]], None]):
        self.capacity, self.windows, self.next_id, self.emit = capacity, windows, first_id, emit
        self.open: list[list] = []  # [room, id, rows]

    def add(self, key: object, start: int, ids: np.ndarray, total: int) -> None:
        at, n = 0, len(ids)
        while at < n:
            left = n - at
            if left >= self.capacity:  # a window of its own
                self._put([self.capacity, self._new(), []], key, start + at, ids[at : at + self.capacity], total)
                at += self.capacity
                continue
            fits = [w for w in self.open if w[0] >= left]
            if fits:
                self._put(min(fits, key=lambda w: (w[0], w[1])), key, start + at, ids[at:], total)
                return
            if len(self.open) < self.windows:
                self.open.append([self.capacity, self._new(), []])
                continue
            full = min(self.open, key=lambda w: (w[0], w[1]))
            take = full[0]
            self._put(full, key, start + at, ids[at : at + take], total)
            at += take

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _put(self, window: list, key: object, start: int, ids: np.ndarray, total: int) -> None:
        window[2].append((key, start, ids, total, window[1], self.capacity - window[0]))
        window[0] -= len(ids)
        if window[0] == 0:
            if window in self.open:
                self.open = [w for w in self.open if w is not window]
            self.emit(window[2])

    def split_last(self) -> None:
        """Emit what is open in windows of a power of two tokens each, which need no padding."""
        for _, _, rows in self.open:
            pieces = [(key, start, ids, total) for key, start, ids, total, _, _ in rows]
            left = sum(len(p[2]) for p in pieces)
            while left:
                size, out, used = 1 << (left.bit_length() - 1), [], 0
                number = self._new()
                while used < size:
                    key, start, ids, total = pieces.pop(0)
                    take = min(len(ids), size - used)
                    out.append((key, start, ids[:take], total, number, used))
                    used += take
                    if take < len(ids):
                        pieces.insert(0, (key, start + take, ids[take:], total))
                self.emit(out)
                left -= size
        self.open = []


COLUMNS = ["key", "doc_row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "ids"]


def _table(rows: list[tuple], task: int, kind: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    blobs = [ids.astype("<u4").tobytes() for _, _, ids, _, _, _ in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0][0] for r in rows], kind), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()),
            pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            pa.array([r[5] for r in rows], pa.int64()), pa.array([task] * len(rows), pa.int64()),
            pa.array(blobs if with_ids else [None] * len(rows), pa.binary()),
        ],
        COLUMNS,
    )


def _merging(level: int, single: bool, capacity: int, with_ids: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs the leftovers of a group of tasks into full windows; at most one stays open, none in the last round."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        group, ready = table["task"][0].as_py() // FAN_IN, []
        packer = Packer(capacity, 1, (level << 58) | (group << 36), ready.extend)
        columns = (table[c].to_pylist() for c in ("key", "doc_row", "start", "doc_tokens", "ids"))
        for key, row, start, total, ids in zip(*columns, strict=True):
            packer.add((key, row), start, np.frombuffer(ids, "<u4"), total)
        if single:
            packer.split_last()
        left = [r for w in packer.open for r in w[2]]
        kind = table.schema.field("key").type
        return pa.Table.from_batches([_table(ready, -1, kind, with_ids), _table(left, group, kind, True)])

    return merge


def pack(
    documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, windows: int = OPEN_WINDOWS,
    with_ids: bool = False, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The pieces of all documents: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, doc_row, ids).

    ``doc_row`` numbers the rows of the input, so pieces of rows that share a key, or have none, can be told apart. A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Every id
    lies in one piece; pieces of a sequence lie end to end from offset 0. All sequences hold ``capacity`` ids but for the
    last few, which hold a power of two each. ``ids`` has the piece's ids (little-endian, 4 bytes each) if
    ``with_ids``, else null. Repeated rows and null keys are packed like any other; an empty table gives
    no piece; further columns are ignored.

    The packing pass is one map over the scan, written once: sequence numbers hold the task, and a
    task that is run again before the commit packs its rows anew as a whole. Leftovers are at most
    ``windows`` sequences a task; rounds of merges take FAN_IN tasks together until one is left.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    base = only(documents, key, text)
    kind = base.schema[key].dataType.simpleString()
    schema = f"key {kind}, doc_row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, ready = encoder(tokenizer), TaskContext.get().partitionId(), []
        packer = Packer(capacity, windows, task << 36, ready.extend)
        tail = np.array([end_id], np.uint32)
        kinds, n = None, task << 36
        for batch in batches:
            kinds = held_by(batch, key).type
            for part in slices(batch, text, 1 << 20):
                for k, t in zip(held_by(part, key).to_pylist(), held_by(part, text).to_pylist(), strict=True):
                    ids = np.concatenate([encode(t), tail]) if t else tail
                    packer.add((k, n), 0, ids, len(ids))
                    n += 1
                if ready:
                    yield _table(ready, -1, kinds, with_ids)
                    ready.clear()
        rows = [r for w in packer.open for r in w[2]]
        if rows:
            yield _table(rows, task, kinds, True)

    packed = materialize(base.mapInArrow(run, schema))
    done = [packed.where("task < 0")]
    open_rows = packed.where("task >= 0")
    last = open_rows.agg(F.max("task")).first()[0]
    level = 0
    while last is not None:
        level, groups, single = level + 1, int(last) // FAN_IN + 1, int(last) < FAN_IN

        merge = _merging(level, single, capacity, with_ids)
        merged = materialize(open_rows.groupBy((F.col("task") / FAN_IN).cast("long").alias("g")).applyInArrow(merge, schema))
        done.append(merged.where("task < 0"))
        open_rows = merged.where("task >= 0")
        last = None if single else groups - 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("key", key).select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "doc_row", "ids")
