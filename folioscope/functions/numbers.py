"""Numeric and time functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years before the second decade of the window count as this one bucket.
BASELINE_DECADE = "1989"


def decade(year: Column) -> Column:
    """1989 for years before 1990, then 1990s to 2020s; null for null."""
    return F.when(year < 1990, BASELINE_DECADE).when(year < 2000, "1990s").when(year < 2010, "2000s").when(year < 2020, "2010s").when(year.isNotNull(), "2020s")


def cagr(begin: Column, end: Column, intervals: Column) -> Column:
    """Compound growth a year, in per cent, over a number of intervals; null if any of the three isn't positive."""
    return F.when((begin > 0) & (end > 0) & (intervals > 0), (F.pow(end.cast("double") / begin, F.lit(1.0) / intervals) - 1) * 100)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Per cent of two integers, rounded half up; null if the whole is 0."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)
