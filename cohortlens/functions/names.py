"""Feature names: normal forms and families. All are column expressions; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_name(x: Column) -> Column:
    """Lower case, nothing else."""
    return F.lower(x)


def marker_name(x: Column, prefix: str = "hsa-") -> Column:
    """Trimmed lower case, with the species prefix where a name starts with ``mir-`` or ``let-``."""
    y = F.lower(F.trim(x))
    return F.when(y.rlike("^(mir|let)-"), F.concat(F.lit(prefix), y)).otherwise(y)


def external_name(x: Column, prefix: str = "hsa-") -> Column:
    """Trimmed lower case, underscores as hyphens, without the species prefix."""
    return F.regexp_replace(F.translate(F.lower(F.trim(x)), "_", "-"), f"^{prefix}", "")


def mature_base(x: Column) -> Column:
    """Without the arm (``-5p``, ``-3p``), then without a numbered arm (``-12p``)."""
    return F.regexp_replace(F.regexp_replace(x, "-[35]p$", ""), r"-\d+p$", "")


def precursor_base_legacy(x: Column) -> Column:
    """Any trailing number goes, even the one that names the family."""
    return F.regexp_replace(x, r"-\d+$", "")


def precursor_family(x: Column) -> Column:
    """A trailing number goes only where a family name remains: ``hsa-mir-19b-2`` but not ``hsa-mir-574``."""
    return F.when(x.isNull(), x).otherwise(
        F.coalesce(F.nullif(F.regexp_extract(x, r"^(hsa-(?:mir|let)-.+)-\d+$", 1), F.lit("")), x)
    )


def mature_family(x: Column) -> Column:
    """The precursor family of a mature name."""
    return precursor_family(mature_base(marker_name(x)))


def external_family(x: Column) -> Column:
    """The family of a name in an external table: no prefix, no arm, no locus number where a family remains."""
    return F.regexp_replace(precursor_family(F.concat(F.lit("hsa-"), mature_base(external_name(x)))), "^hsa-", "")


def display_name(x: Column) -> Column:
    return F.regexp_replace(marker_name(x), "^hsa-", "")
