"""Characters and hashed character n-grams of a slice of texts, as flat numpy arrays."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import SLICE, utf8

STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """For each code point the code point of its one-character lower case form."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(0x41, 0x20000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _decoded(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def characters(batch: pa.RecordBatch, column: str, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(code points on end, where each row begins with the end of the last, lead, tail) of a slice.

    A long text comes in pieces of about a slice. Each has up to ``overlap`` characters of the pieces
    before and after, ``lead`` and ``tail`` of them, so that whatever looks that far sees all it needs.
    """
    data, at = utf8(batch, column)
    if batch.num_rows > 1 or len(data) <= 2 * SLICE:
        seen = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=seen[1:])
        yield _decoded(data), seen[at], 0, 0
        return

    def whole(p: int) -> int:
        """The next position at which a character begins."""
        while p < len(data) and data[p] & 0xC0 == 0x80:
            p += 1
        return p

    for begin in range(0, len(data), SLICE):
        first, end = whole(begin), whole(min(begin + SLICE, len(data)))
        before, after = whole(max(0, first - 4 * overlap)), whole(min(end + 4 * overlap, len(data)))
        lead, tail = _decoded(data[before:first])[-overlap:] if overlap else [], _decoded(data[end:after])[:overlap]
        chars = np.concatenate([lead, _decoded(data[first:end]), tail]).astype(np.uint32)
        yield chars, np.array([0, len(chars)]), len(lead), len(tail)


def hashed(chars: np.ndarray, at: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the given sizes; none spans two rows."""
    rows = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    left = at[1:][rows] - np.arange(len(chars)) if len(chars) else np.zeros(0, np.int64)
    out_rows, out = [], []
    wide = chars.astype(np.uint64) + np.uint64(1)
    code = wide.copy()
    for n in range(2, max(sizes) + 1):
        if len(code) < 2:
            break
        code = code[:-1] * STEP + wide[n - 1 :]
        if n in sizes:
            keep = left[: len(code)] >= n
            x = code[keep] ^ np.uint64(n)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xD6E8FEB86659FD93)
            out.append((x >> np.uint64(64 - bits)).astype(np.int32))
            out_rows.append(rows[: len(code)][keep])
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(out_rows), np.concatenate(out)


def distinct(rows: np.ndarray, buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, bucket) once, by row."""
    key = np.unique((rows.astype(np.int64) << bits) | buckets)
    return (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32)
