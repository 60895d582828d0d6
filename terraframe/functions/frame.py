"""Coordinate expressions: record, pixel, world and scene coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraframe.functions.numeric import ColumnLike, bound, col, fract


def scale_offset(raw: ColumnLike, scale: ColumnLike, offset: ColumnLike) -> Column:
    """Integer record coordinate to world."""
    return col(raw) * col(scale) + col(offset)


def to_scene(
    x: ColumnLike, y: ColumnLike, z: ColumnLike, frame: Column, z_factor: float = 1.0
) -> dict[str, Column]:
    """World to scene axes: east, up, south. ``frame`` is a struct(cx, cy, cz, scale)."""
    s = frame["scale"]
    return {
        "gx": (col(x) - frame["cx"]) / s,
        "gy": (col(z) - frame["cz"]) / s * z_factor,
        "gz": -(col(y) - frame["cy"]) / s,
    }


def to_world(
    gx: ColumnLike, gy: ColumnLike, gz: ColumnLike, frame: Column, z_factor: float = 1.0
) -> dict[str, Column]:
    s = frame["scale"]
    return {
        "x": frame["cx"] + col(gx) * s,
        "y": frame["cy"] - col(gz) * s,
        "z": frame["cz"] + col(gy) / z_factor * s,
    }


def pixel_to_world(column: ColumnLike, row: ColumnLike, geo: Column) -> dict[str, Column]:
    """Pixel-centre position of (column, row); ``geo`` is a struct(a, b, c, d, e, f)."""
    q, r = col(column), col(row)
    return {
        "x": geo["c"] + geo["a"] * q + geo["b"] * r,
        "y": geo["f"] + geo["d"] * q + geo["e"] * r,
    }


def world_to_pixel(x: ColumnLike, y: ColumnLike, geo: Column) -> dict[str, Column]:
    """Fractional pixel of a world point; null for a degenerate affine."""
    dx, dy = col(x) - geo["c"], col(y) - geo["f"]
    det = geo["a"] * geo["e"] - geo["b"] * geo["d"]
    usable = F.abs(det) >= 1e-15
    return {
        "px": F.when(usable, (geo["e"] * dx - geo["b"] * dy) / det),
        "py": F.when(usable, (geo["a"] * dy - geo["d"] * dx) / det),
    }


def corner_to_centre(gt: list[ColumnLike]) -> dict[str, Column]:
    """Six corner-origin geotransform numbers to the pixel-centre affine."""
    g = [col(v) for v in gt]
    return {
        "a": g[1],
        "b": g[2],
        "c": g[0] + g[1] / 2 + g[2] / 2,
        "d": g[4],
        "e": g[5],
        "f": g[3] + g[4] / 2 + g[5] / 2,
    }


def rescale_affine(
    gt: list[ColumnLike],
    src_w: ColumnLike,
    src_h: ColumnLike,
    dst_w: ColumnLike,
    dst_h: ColumnLike,
) -> dict[str, Column]:
    """Affine of the same extent on another pixel count."""
    g = [col(v) for v in gt]
    sx, sy = col(src_w) / col(dst_w), col(src_h) / col(dst_h)
    return corner_to_centre([g[0], g[1] * sx, g[2] * sy, g[3], g[4] * sx, g[5] * sy])


def has_georeference(gt: list[ColumnLike]) -> Column:
    """False for the identity geotransform, which stands for "none"."""
    same = F.lit(True)
    for value, identity in zip(gt, (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), strict=True):
        same = same & (col(value) == identity)
    return ~same


def raster_extent(geo: Column, width: ColumnLike, height: ColumnLike) -> dict[str, Column]:
    """Box of the four corner pixel centres."""
    w, h = col(width) - 1, col(height) - 1
    xs = [geo["c"], geo["c"] + geo["a"] * w, geo["c"] + geo["b"] * h]
    xs.append(geo["c"] + geo["a"] * w + geo["b"] * h)
    ys = [geo["f"], geo["f"] + geo["d"] * w, geo["f"] + geo["e"] * h]
    ys.append(geo["f"] + geo["d"] * w + geo["e"] * h)
    return {
        "minx": F.least(*xs),
        "miny": F.least(*ys),
        "maxx": F.greatest(*xs),
        "maxy": F.greatest(*ys),
    }


def geo_struct(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + k).alias(k) for k in "abcdef"))


def fine_hash(gx: ColumnLike, gy: ColumnLike, gz: ColumnLike) -> Column:
    """Stable pseudo-random number in [0, 1) of a scene position."""
    # The hash's scale, multiplier and offset.
    scale, multiplier, offset = 1000.0, 0.1031, 31.32
    places = F.struct(*(fract(col(v) * scale * multiplier).alias(k) for k, v in zip("xyz", (gx, gy, gz), strict=True)))

    def mixed(p: Column) -> Column:
        x, y, z = p["x"], p["y"], p["z"]
        dot = x * (z + offset) + y * (y + offset) + z * (x + offset)
        return bound(dot, lambda d: ((x + d) + (y + d)) * (z + d))

    return bound(bound(places, mixed), fract)


def texel_uv(
    column: ColumnLike, row: ColumnLike, width: ColumnLike, height: ColumnLike
) -> dict[str, Column]:
    """Texture position of a pixel in its own raster."""
    return {"u": (col(column) + 0.5) / col(width), "v": (col(row) + 0.5) / col(height)}


def image_uv(
    column: ColumnLike,
    row: ColumnLike,
    geo: Column,
    width: ColumnLike,
    height: ColumnLike,
    image_geo: Column,
    image_width: ColumnLike,
    image_height: ColumnLike,
) -> dict[str, Column]:
    """Texture position of a terrain pixel in the image.

    A null ``image_geo`` means an image without georeference, stretched over
    the raster.
    """
    q, r = col(column), col(row)
    w, h = col(width), col(height)
    ia, ie = image_geo["a"], image_geo["e"]
    pc = F.when(ia != 0, (geo["c"] + geo["a"] * q - image_geo["c"]) / ia).otherwise(0.0)
    pr = F.when(ie != 0, (geo["f"] + geo["e"] * r - image_geo["f"]) / ie).otherwise(0.0)
    stretched = image_geo.isNull()
    return {
        "iu": F.when(stretched, F.when(w > 1, q / (w - 1)).otherwise(0.5)).otherwise(
            (pc + 0.5) / col(image_width)
        ),
        "iv": F.when(stretched, F.when(h > 1, r / (h - 1)).otherwise(0.5)).otherwise(
            (pr + 0.5) / col(image_height)
        ),
    }


def view_position(
    tx: ColumnLike,
    ty: ColumnLike,
    tz: ColumnLike,
    yaw: ColumnLike,
    pitch: ColumnLike,
    distance: ColumnLike,
) -> dict[str, Column]:
    """Eye of a view orbiting the scene point (tx, ty, tz); angles in radians."""
    flat = col(distance) * F.cos(col(pitch))
    return {
        "ex": col(tx) + flat * F.sin(col(yaw)),
        "ey": col(ty) + col(distance) * F.sin(col(pitch)),
        "ez": col(tz) + flat * F.cos(col(yaw)),
    }


def view_axes(yaw: ColumnLike, pitch: ColumnLike) -> dict[str, tuple[Column, Column, Column]]:
    """Forward, right and up unit vectors of an orbiting view."""
    y, p = col(yaw), col(pitch)
    forward = (-F.cos(p) * F.sin(y), -F.sin(p), -F.cos(p) * F.cos(y))
    right = (F.cos(y), F.lit(0.0), -F.sin(y))
    up = (-F.sin(p) * F.sin(y), F.cos(p), -F.sin(p) * F.cos(y))
    return {"forward": forward, "right": right, "up": up}
