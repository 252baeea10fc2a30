"""Numbers as the text of reports and pages. Null stays null; a decimal form that ends halfway is rounded away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _printed(pattern: str, x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string(pattern, x.cast("double")))


def fixed(x: Column, digits: int = 2) -> Column:
    """A fixed number of decimals, without thousands separators."""
    return _printed(f"%.{digits}f", x)


def exponential(x: Column, digits: int = 6) -> Column:
    """One digit before the point and an exponent without leading zeros, as p-values are written: 1.500000e-7."""
    return F.regexp_replace(_printed(f"%.{digits}e", x), "e([+-])0(?=[0-9])", "e$1")


def percent(x: Column, digits: int = 2) -> Column:
    return F.concat(fixed(100 * x, digits), F.lit("%"))


def points(x: Column, digits: int = 2) -> Column:
    """A difference of shares in signed percentage points; zero counts as positive."""
    return F.concat(F.when(x >= 0, "+").otherwise(""), fixed(100 * x, digits))


def grouped(n: Column) -> Column:
    """A whole number with points between thousands: 1.234.567."""
    return F.translate(F.format_number(n.cast("long"), 0), ",", ".")


def display_value(x: Column) -> Column:
    """A cell of a view: two decimals from 10 on, else four."""
    return F.when(F.abs(x) >= 10, fixed(x, 2)).otherwise(fixed(x, 4))
