"""Vectors of whole numbers: making them in the JVM, reading them as numpy grids, exact products and distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .mtree import quantize

#: Squared norms of vectors of whole numbers stay below this, so products and squared distances fit 64 bits.
NORM_LIMIT = float(1 << 60)
#: Whole numbers up to this are exact in double precision.
EXACT = float(1 << 53)


def whole_vector(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null where a component is null or not finite, and where the squared norm reaches 2^60."""
    v = quantize(embedding, scale)
    norm = F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.when(norm < NORM_LIMIT, v)


def by_length(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: the rows that have it, and their vectors as a grid."""
    ends = np.asarray(lists.offsets)
    flat, ends = np.asarray(lists.flatten()), ends - ends[0]
    sizes = np.diff(ends)
    out = {}
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        out[size] = own, flat[ends[own][:, None] + np.arange(size)[None, :]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two grids of int64: by the fast double product where that is exact."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of the rows of two grids of int64."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * products(a, b)
