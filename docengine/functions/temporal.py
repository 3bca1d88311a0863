"""Dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.nulls import col


def parse_instant(x: Column | str) -> Column:
    """ISO text to a timestamp: Z and offsets read, naive means UTC, anything else null."""
    t = F.regexp_replace(F.trim(col(x)), "[zZ]$", "+00:00")
    return F.try_to_timestamp(t)


def iso_seconds(x: Column | str) -> Column:
    return F.date_format(col(x), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def duration_seconds(start: Column, end: Column, now: Column) -> Column:
    """Whole seconds from start to end, or to now if there's no end; 0 for a missing start or an end before it."""
    return F.greatest(F.coalesce(F.unix_seconds(F.coalesce(end, now).cast("timestamp")) - F.unix_seconds(start.cast("timestamp")), F.lit(0)), F.lit(0)).cast("long")


def duration_label(seconds: Column | str) -> Column:
    """H小时M分S秒, leading zero parts left out."""
    s = col(seconds)
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    part = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    return F.when(h > 0, F.concat(part(h, "小时"), part(m, "分"), part(r, "秒"))).when(m > 0, F.concat(part(m, "分"), part(r, "秒"))).otherwise(part(r, "秒"))


def expired(x: Column | str, cutoff: Column) -> Column:
    """At or before the cutoff; what can't be read stays."""
    return F.coalesce(col(x) <= cutoff, F.lit(False))
