"""Reproducible hashes and draws: 32-bit FNV-1a, a counter-based generator, a linear congruential one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
COUNTER_STEP = 0x6D2B79F5
LCG_FACTOR, LCG_INCREMENT = 1664525, 1013904223


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, as a nonnegative long."""
    letters = F.filter(F.split(x, ""), lambda c: c != "")
    mask = F.lit(MASK).cast("long")
    return F.aggregate(
        letters, F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(mask)
    )


def fnv1a_py(text: str) -> int:
    h = FNV_OFFSET
    for c in text:
        h = ((h ^ (ord(c) & 0xFFFF if ord(c) < 0x10000 else 0xD800 + ((ord(c) - 0x10000) >> 10))) * FNV_PRIME) & MASK
    return h


def fnv1a_np(prefix: str, texts: list[str]) -> np.ndarray:
    """The same of a prefix with each of the texts."""
    h, letters = np.full(len(texts), fnv1a_py(prefix), np.uint64), np.array(texts, dtype=str)
    points = letters.view(np.uint32).reshape(len(texts), -1).astype(np.uint64) if len(texts) and letters.itemsize else np.zeros((len(texts), 0), np.uint64)
    units = np.where(points < 0x10000, points, 0xD800 + ((points - 0x10000) >> np.uint64(10)))
    for j in range(units.shape[1]):
        h = np.where(points[:, j] > 0, ((h ^ units[:, j]) * np.uint64(FNV_PRIME)) & np.uint64(MASK), h)
    return h.astype(np.int64)


def _mul32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two unsigned 32-bit longs, without overflow."""
    low, high = b.bitwiseAND(F.lit(65535).cast("long")), F.shiftrightunsigned(b, 16)
    return (a * low + (a * high).bitwiseAND(F.lit(65535).cast("long")) * 65536).bitwiseAND(F.lit(MASK).cast("long"))


def counter_uniform(seed: int, i: Column) -> Column:
    """Draw ``i`` (from 0) of the counter-based generator, from 0 to below 1; draws are independent of each other."""
    mask = F.lit(MASK).cast("long")
    s = (F.lit(seed).cast("long") + (i.cast("long") + 1) * F.lit(COUNTER_STEP).cast("long")).bitwiseAND(mask)
    v = _mul32(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1).cast("long")))
    w = v.bitwiseXOR((v + _mul32(v.bitwiseXOR(F.shiftrightunsigned(v, 7)), v.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask))
    return w.bitwiseXOR(F.shiftrightunsigned(w, 14)) / F.lit(4294967296.0)


def counter_uniform_at(seed: int, i: np.ndarray) -> np.ndarray:
    """Draws number ``i`` of the same generator."""
    m = np.uint64(MASK)
    s = (np.uint64(seed) + (i.astype(np.uint64) + np.uint64(1)) * np.uint64(COUNTER_STEP)) & m
    v = ((s ^ (s >> np.uint64(15))) * (s | np.uint64(1))) & m
    w = v ^ ((v + (((v ^ (v >> np.uint64(7))) * (v | np.uint64(61))) & m)) & m)
    return (w ^ (w >> np.uint64(14))).astype(float) / 4294967296.0


def counter_uniform_np(seed: int, n: int) -> np.ndarray:
    """The first ``n`` draws of the same generator."""
    return counter_uniform_at(seed, np.arange(n))


class CongruentialDraws:
    """The sequential generator state -> state * 1664525 + 1013904223 mod 2^32; draws are state / 2^32."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def draw(self) -> float:
        self.state = (self.state * LCG_FACTOR + LCG_INCREMENT) & MASK
        return self.state / 4294967296.0

    def skip(self, n: int) -> CongruentialDraws:
        """The same after n draws, without making them: steps of powers of two."""
        factor, add = LCG_FACTOR, LCG_INCREMENT
        while n:
            if n & 1:
                self.state = (self.state * factor + add) & MASK
            factor, add = (factor * factor) & MASK, (add * (factor + 1)) & MASK
            n >>= 1
        return self

    def shuffle(self, items: list) -> list:
        """Fisher-Yates from the end, in place."""
        for i in range(len(items) - 1, 0, -1):
            j = int(self.draw() * (i + 1))
            items[i], items[j] = items[j], items[i]
        return items
