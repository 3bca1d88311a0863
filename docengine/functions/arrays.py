"""Ragged matrices, sparse vectors, maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.nulls import col


def padded(rows: Column | str) -> Column:
    """A ragged matrix of strings as a rectangle; gaps are empty."""
    r = col(rows)
    width = F.coalesce(F.array_max(F.transform(r, lambda x: F.size(x))), F.lit(0))
    return F.transform(r, lambda x: F.concat(x, F.array_repeat(F.lit(""), width - F.size(x))))


def sub_matrix(rows: Column | str, top: int, left: int, height: int, width: int) -> Column:
    return F.transform(F.slice(col(rows), top, height), lambda r: F.slice(r, left, width))


def dense(sparse: Column | str, default: str = "") -> Column:
    """Index -> value as a vector from 0; a gap is the default, never zero."""
    m = col(sparse)
    last = F.coalesce(F.array_max(F.map_keys(m)), F.lit(-1))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(default)))).otherwise(F.array().cast("array<string>"))


def merged(first: Column | str, second: Column | str) -> Column:
    """Two maps; the second's values win."""
    a, b = col(first), col(second)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def ordered_distinct(x: Column | str) -> Column:
    return F.array_distinct(col(x))


def top_entries(m: Column | str, n: int = 12) -> Column:
    return F.slice(F.array_sort(F.map_entries(col(m))), 1, n)


def subset(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_except(col(a), col(b))) == 0


def union_keys(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(F.array_union(F.map_keys(col(a)), F.map_keys(col(b))))
