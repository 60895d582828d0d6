"""Predicates and small rules on scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraframe.functions.numeric import ColumnLike, clamp, col

# Fixed values, by point format 0-10: minimum record length and byte offset
# of the colour triple (-1: the format has none).
MIN_RECORD_LENGTH = (20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67)
COLOUR_OFFSET = (-1, -1, 20, 28, -1, 28, -1, 30, 30, -1, 30)
# Nodata written by composed rasters, limit when none is declared.
NODATA = -9999.0
UNDECLARED_LIMIT = -9000.0


def is_nodata(value: ColumnLike, declared: ColumnLike | None) -> Column:
    """True for an unknown pixel.

    ``declared`` null: nothing declared, anything below -9000 is unknown.
    A declared NaN matches only NaN.
    """
    v = col(value)
    unknown = v.isNull() | F.isnan(v)
    if declared is None:
        return unknown | (v < UNDECLARED_LIMIT)
    nd = col(declared)
    tolerance = F.lit(1e-3) * F.greatest(F.lit(1.0), F.abs(nd))
    matches = (
        F.when(nd.isNull(), v < UNDECLARED_LIMIT)
        .when(F.isnan(nd), F.lit(False))
        .otherwise(F.abs(v - nd) < tolerance)
    )
    return unknown | matches


def valid_or_null(value: ColumnLike, declared: ColumnLike | None) -> Column:
    return F.when(~is_nodata(value, declared), col(value))


def terrain_rgb(red: ColumnLike, green: ColumnLike, blue: ColumnLike) -> Column:
    """Elevation packed in three bytes; null below the limit."""
    v = (col(red) * 65536 + col(green) * 256 + col(blue)) * F.lit(0.1) - 10000.0
    return F.when(v >= UNDECLARED_LIMIT, v)


def depth_at_resolution(spacing: ColumnLike, max_depth: ColumnLike, resolution: ColumnLike) -> Column:
    """Shallowest depth whose spacing, halved per depth, is at most ``resolution``."""
    # Comparing spacing with resolution * 2^d avoids a logarithm, whose
    # rounding is wrong exactly at the powers of two.
    s, m, res = col(spacing), col(max_depth).cast("int"), col(resolution)
    fits = F.filter(
        F.sequence(F.lit(0), m), lambda d: s <= res * F.pow(F.lit(2.0), d.cast("double"))
    )
    return F.when(res <= 0, m).otherwise(F.coalesce(F.get(fits, F.lit(0)), m)).cast("int")


def level_for_span(cell_w: ColumnLike, cell_h: ColumnLike, max_span: ColumnLike) -> Column:
    """Smallest quadtree level whose cells span at most ``max_span`` pixels, at most 20."""
    size = F.greatest(col(cell_w), col(cell_h))
    span = col(max_span)
    fits = F.filter(
        F.sequence(F.lit(0), F.lit(20)),
        lambda k: (size <= span * F.pow(F.lit(2.0), k.cast("double"))) | (k == 20),
    )
    return F.get(fits, F.lit(0)).cast("int")


def valid_format(format_id: ColumnLike, record_length: ColumnLike) -> Column:
    """Known point format (compression bits masked) with a long enough record."""
    f = col(format_id).bitwiseAND(F.lit(0x3F))
    minimum = F.get(F.array(*map(F.lit, MIN_RECORD_LENGTH)), f.cast("int"))
    return F.coalesce((f <= 10) & (col(record_length) >= minimum), F.lit(False))


def colour_offset(format_id: ColumnLike) -> Column:
    f = col(format_id).bitwiseAND(F.lit(0x3F)).cast("int")
    return F.get(F.array(*map(F.lit, COLOUR_OFFSET)), f)


def in_tile(
    x: ColumnLike,
    y: ColumnLike,
    tile: Column,
    cloud_maxx: ColumnLike,
    cloud_maxy: ColumnLike,
) -> Column:
    """Half-open tile box; the last row and column also take the cloud's far edge."""

    def axis(v: Column, low: Column, high: Column, last: Column) -> Column:
        return (v >= low) & ((v < high) | ((high >= last) & (v <= high)))

    return axis(col(x), tile["minx"], tile["maxx"], col(cloud_maxx)) & axis(
        col(y), tile["miny"], tile["maxy"], col(cloud_maxy)
    )


def boxes_meet(a: Column, b: Column) -> Column:
    """Closed boxes share at least a point."""
    return (
        (a["minx"] <= b["maxx"])
        & (a["maxx"] >= b["minx"])
        & (a["miny"] <= b["maxy"])
        & (a["maxy"] >= b["miny"])
    )


def node_box(depth: ColumnLike, nx: ColumnLike, ny: ColumnLike, root: Column) -> Column:
    """Footprint of octree node (depth, nx, ny) in a root cube struct(minx, miny, side)."""
    side = root["side"] / F.pow(F.lit(2.0), col(depth).cast("double"))
    x0 = root["minx"] + col(nx) * side
    y0 = root["miny"] + col(ny) * side
    return F.struct(
        x0.alias("minx"), y0.alias("miny"), (x0 + side).alias("maxx"), (y0 + side).alias("maxy")
    )


def coarse_resolution(tile_area: ColumnLike) -> Column:
    """Point spacing of a first pass of about 500 points a tile."""
    return clamp(F.sqrt(col(tile_area) / 500.0), 1.0, 50.0)


def keep_probability(
    density: ColumnLike,
    depth: ColumnLike,
    fov_deg: float,
    viewport_h: float,
    pixel_spacing: float = 2.83,
    multiplier: float = 1.0,
) -> Column:
    """Share of points to keep so that they end about ``pixel_spacing`` pixels apart."""
    near = F.greatest(col(depth), F.lit(0.001))
    spacing = near * F.lit(pixel_spacing * 2.0) * F.tan(F.radians(F.lit(fov_deg)) * 0.5)
    spacing = spacing / F.lit(viewport_h * multiplier)
    return clamp(F.lit(1.0) / F.greatest(col(density) * spacing * spacing, F.lit(1.0)), 0.0, 1.0)
