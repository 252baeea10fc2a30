"""Short RNA sequences as feature sets. All are column expressions over a sequence column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_sequence(x: Column) -> Column:
    """Upper case, T as U, everything but A, C, G and U dropped; null is empty.

    Runs of letters other than these, in either case, go first, so the rest of the work is on a quarter of a text.
    """
    return F.coalesce(F.translate(F.upper(F.regexp_replace(x, "[^ACGTUacgtu]+", "")), "T", "U"), F.lit(""))


def seed(x: Column) -> Column:
    """Letters 2 to 8."""
    return F.substring(x, 2, 7)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often a lambda inside looks at it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _letters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _each_kmer(letters: Column, k: int, f: Callable[[Column, Column], Column]) -> Column:
    """``f(k-mer, position from 1)`` of all k-mers of an array of letters, in order; none where there are fewer letters."""
    n = F.size(letters)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1))
    return F.when(n >= k, F.transform(starts, lambda i: f(F.array_join(F.slice(letters, i, F.lit(k)), ""), i))).otherwise(F.array().cast("array<string>"))


def kmers(x: Column, sizes: list[int]) -> Column:
    """All substrings of the given sizes, in order; none where the sequence is shorter. The work grows with the length, not its square."""
    return _bound(_letters(x), lambda s: F.flatten(F.array(*(_each_kmer(s, k, lambda m, i: m) for k in sizes))))


def positional_kmers(x: Column, sizes: list[int]) -> Column:
    """K-mers tagged by where their middle lies: first third ``5p``, second ``center``, last ``3p``."""

    def tagged(letters: Column, k: int) -> Column:
        def tag(kmer: Column, i: Column) -> Column:
            middle = (i - 1 + F.lit(k / 2)) / F.greatest(F.lit(1), F.size(letters))
            region = F.when(middle < 1 / 3, "5p").when(middle < 2 / 3, "center").otherwise("3p")
            return F.concat(F.lit("positional:"), region, F.lit(":"), kmer)

        return _each_kmer(letters, k, tag)

    return _bound(_letters(x), lambda s: F.flatten(F.array(*(tagged(s, k) for k in sizes))))


def terminal_motifs(x: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """First and last letters of each size as tagged features."""
    parts = [
        F.when(F.length(x) >= k, F.array(F.concat(F.lit(f"terminal:5p:{k}:"), F.left(x, F.lit(k))), F.concat(F.lit(f"terminal:3p:{k}:"), F.right(x, F.lit(k)))))
        .otherwise(F.array().cast("array<string>"))
        for k in sizes
    ]
    return F.flatten(F.array(*parts))


def base_fraction(x: Column, bases: str) -> Column:
    """Share of letters in ``bases``; 0 for an empty sequence."""
    return F.length(F.regexp_replace(x, f"[^{bases}]", "")) / F.greatest(F.lit(1), F.length(x))


def gc_fraction(x: Column) -> Column:
    return base_fraction(x, "GC")


def entropy(x: Column) -> Column:
    """Shannon entropy of the four letters in bits, halved: from 0 to 1."""

    def part(b: str) -> Column:
        p = base_fraction(x, b)
        return F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    return -(part("A") + part("C") + part("G") + part("U")) / 2


def position_matches(a: Column, b: Column, size: int = 7) -> Column:
    """Share of positions with equal letters, over the longer length; 0 for two empty strings."""
    hits = F.lit(0)
    for i in range(1, size + 1):
        x, y = F.substring(a, i, 1), F.substring(b, i, 1)
        hits = hits + F.when((x == y) & (x != ""), 1).otherwise(0)
    return hits / F.greatest(F.length(a), F.length(b), F.lit(1))
