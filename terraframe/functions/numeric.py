"""Small numeric helpers shared by the expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | int | float


def col(value: ColumnLike) -> Column:
    """A column from a column, a column name or a number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def clamp(value: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    """``value`` limited to [low, high]; null stays null (unlike least/greatest)."""
    v, lo, hi = col(value), col(low), col(high)
    return F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))


def fract(value: ColumnLike) -> Column:
    v = col(value)
    return v - F.floor(v)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
