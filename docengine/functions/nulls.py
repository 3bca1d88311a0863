"""Null and truth discipline: a missing value, an empty string and zero are all 'not given'."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def given(x: Column | str) -> Column:
    """x, or null if it is an empty string."""
    return F.nullif(col(x), F.lit(""))


def first_given(*xs: Column | str) -> Column:
    """The first value that is neither null nor empty; later spellings of a key back up the first."""
    return F.coalesce(*[given(x) for x in xs])


def truthy(x: Column | str, kind: str = "boolean") -> Column:
    """Truth without a third value: null, false, zero and the empty string or array are false."""
    c = col(x)
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind == "array":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def not_in_or_null(x: Column | str, *values: str) -> Column:
    """Anything but the values; a missing x counts as outside them, which NOT IN loses."""
    return ~F.coalesce(col(x), F.lit("")).isin(*values)


def safe_int(x: Column | str) -> Column:
    """Whole numbers from 0; junk, nulls and negatives are 0."""
    return F.greatest(F.coalesce(col(x).try_cast("int"), F.lit(0)), F.lit(0))


def any_of(*xs: Column) -> Column:
    return reduce(lambda a, b: a | b, [truthy(x) for x in xs])
