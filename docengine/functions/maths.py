"""Exact rounding, units and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.nulls import col

#: English metric units in one of each (fixed values).
EMU = {"in": 914400, "cm": 360000, "mm": 36000, "pt": 12700, "pc": 152400, "px": 9525}


def half_up(x: Column | str, scale: int) -> Column:
    """x times scale as a whole number, halves away from zero, exact in decimals."""
    return F.round(col(x).cast("decimal(20,6)") * F.lit(scale).cast("decimal(10,0)"), 0).cast("long")


def angle_60000(degrees: Column | str) -> Column:
    """Degrees, any turn, as sixty-thousandths in one turn."""
    return F.pmod(half_up(degrees, 60000), F.lit(21_600_000).cast("long"))


def to_emu(length: Column | str) -> Column:
    """A length with its unit (2.5cm, 12pt) in whole EMU, cut off; bare numbers, percentages and anything else are 0."""
    said = F.lower(F.trim(col(length)))
    part = lambda i: F.regexp_extract(said, r"^([0-9]+(?:\.[0-9]+)?)\s*(in|cm|mm|pt|pc|px)$", i)
    factor = F.try_element_at(F.create_map(*[F.lit(v) for kv in EMU.items() for v in kv]), part(2))
    return F.coalesce(F.floor(part(1).try_cast("decimal(20,6)") * factor), F.lit(0)).cast("long")


def emu_to_twips(h: Column | str) -> Column:
    return F.floor((col(h) + 317) / 635).cast("long")


def finite_decimal(x: Column | str) -> Column:
    """An exact decimal, or null for text, NaN and infinities."""
    return F.when(F.trim(col(x)).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(col(x)).try_cast("decimal(38,15)"))


def rotated_box(w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height of the upright box around a turned one."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return w * c + h * s, w * s + h * c


def fit_scale(w: Column, h: Column, max_w: Column, max_h: Column) -> Column:
    """The factor that fits a box into another without enlarging it."""
    return F.least(F.lit(1.0), max_w / w, max_h / h)
