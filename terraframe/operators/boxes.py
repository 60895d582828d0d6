"""Join of boxes that overlap, as an equi-join on a hierarchical grid.

A theta join on box overlap makes Spark compare every pair. Here each box
gets the power-of-two cell size that is at least its longer side, so at that
level (and any coarser one) it touches at most 2 x 2 cells. A pair meets at
the coarser of its two levels, in the one cell that holds the lower corner
of the intersection: no pair is missed and none is reported twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.operators.lookup import known

_MIN_LEVEL, _MAX_LEVEL = -30, 60
# Point against box: cells this many halvings smaller than the box. At most
# 5 x 5 cells a box, and few points of them outside it.
_FINER = 2


def _level(b: str, finer: int = 0) -> str:
    side = f"greatest({b}.maxx - {b}.minx, {b}.maxy - {b}.miny, {2.0**_MIN_LEVEL!r}D)"
    return f"cast(least(greatest(ceil(log2({side})) - {finer}, {_MIN_LEVEL}), {_MAX_LEVEL}) AS int)"


def _cell(value: str) -> str:
    return f"floor({value} * pow(2D, cast(-__lv AS double)))"


def _cells(df: DataFrame, b: str, tag: str) -> DataFrame:
    """One row per cell of level __lv that the box touches."""
    cx = f"explode(sequence({_cell(b + '.minx')}, {_cell(b + '.maxx')})) AS __cx"
    cy = f"explode(sequence({_cell(b + '.miny')}, {_cell(b + '.maxy')})) AS __cy"
    return df.where(f"__lv >= __{tag}_level").selectExpr("*", cx).selectExpr("*", cy)


def overlap_join(
    left: DataFrame, right: DataFrame, left_box: str, right_box: str, left_points: bool = False
) -> DataFrame:
    """Pairs whose closed boxes (struct minx, miny, maxx, maxy) meet.

    Column names of the two sides must differ. Boxes with a null or inverted
    side match nothing. ``left_points``: the left boxes are single points, so
    pairs always meet at the right box's own level and only the right side is
    examined for levels; the left may then be a stream.
    """
    a, b = left_box, right_box

    def usable(df: DataFrame, box_name: str, tag: str, finer: int = 0) -> DataFrame:
        ok = f"{box_name}.minx <= {box_name}.maxx AND {box_name}.miny <= {box_name}.maxy"
        return df.where(ok).selectExpr("*", f"{_level(box_name, finer)} AS __{tag}_level")

    # the right side is looked at twice, for its levels and for its boxes: written once, if it is not stored
    left, right = usable(left, a, "l"), usable(known(right), b, "r", _FINER if left_points else 0)
    # The distinct levels: at most 91 integers by construction.
    seen = right.selectExpr("__r_level AS v")
    if not left_points:
        seen = seen.union(left.selectExpr("__l_level AS v"))
    levels = seen.agg(F.collect_set("v")).scalar()
    spread_left = left.withColumn("__lv", F.explode(levels))
    if left_points:
        spread_right = right.withColumn("__lv", F.col("__r_level"))
    else:
        spread_right = right.withColumn("__lv", F.explode(levels))
    pairs = _cells(spread_left, a, "l").join(_cells(spread_right, b, "r"), ["__lv", "__cx", "__cy"])
    meets = (
        f"{a}.minx <= {b}.maxx AND {a}.maxx >= {b}.minx"
        f" AND {a}.miny <= {b}.maxy AND {a}.maxy >= {b}.miny"
    )
    if not left_points:  # a point is in one cell only and needs no such choice
        meets += (
            " AND __lv = greatest(__l_level, __r_level)"
            f" AND __cx = {_cell(f'greatest({a}.minx, {b}.minx)')}"
            f" AND __cy = {_cell(f'greatest({a}.miny, {b}.miny)')}"
        )
    return pairs.where(meets).drop("__lv", "__cx", "__cy", "__l_level", "__r_level")


def overlap_area(a: Column, b: Column) -> Column:
    """Area of the intersection, 0 when the boxes only touch or do not meet."""
    w = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    h = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.struct(
        minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy")
    )
