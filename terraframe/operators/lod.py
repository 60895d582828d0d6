"""Which tiles a set of viewpoints needs, and how finely.

Tiles are in scene coordinates: file_id, gx, gy, point_count, tile_area (in
square metres), e1..e3 and a1..a3 (principal extents and axes) and box, a
struct(lox, loy, loz, hix, hiy, hiz). Views: view_id and eye ex, ey, ez.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraframe.functions.frame import fine_hash, view_axes, view_position
from terraframe.functions.rules import coarse_resolution, keep_probability
from terraframe.operators.boxes import overlap_join
from terraframe.operators.lookup import join_catalog
from terraframe.session import spread

# Pixels per point, smallest area worth refining, point and
# resolution limits, refinement factor.
PIXELS_PER_POINT = 25.0
MIN_POINTS, MAX_POINTS = 100.0, 500000.0
COARSEST, FINEST = 50.0, 0.1
REFINE_FACTOR = 1.5


def pixels_per_unit(fov_deg: float, viewport_h: float) -> float:
    """On-screen pixels of one scene unit at distance 1."""
    return viewport_h / (2.0 * math.tan(math.radians(fov_deg) * 0.5))


# Per tile, once: middle of the box and the areas of its three faces.
_TILE_SHAPE = (
    *(f"(box.lo{k} + box.hi{k}) * 0.5D AS m{k}" for k in "xyz"),
    "4D * e2 * e3 AS f1",
    "4D * e1 * e3 AS f2",
    "4D * e1 * e2 AS f3",
)
_DISTANCE = "sqrt((mx - ex) * (mx - ex) + (my - ey) * (my - ey) + (mz - ez) * (mz - ez))"


def views_tiles(
    views: DataFrame, tiles: DataFrame, fov_deg: float = 55.0, viewport_h: float = 900.0
) -> DataFrame:
    """Pairs of a view and a tile near enough to be refined for it.

    Every other pair would get resolution 0 ("leave as it is"), so the
    product of views and tiles is never formed: each tile is looked for
    within its own reach.
    """
    scale = pixels_per_unit(fov_deg, viewport_h)
    reached = (
        spread(tiles, "file_id", "gx", "gy")
        .selectExpr("*", *_TILE_SHAPE)
        .selectExpr("*", f"sqrt((f1 + f2 + f3) / {PIXELS_PER_POINT}D) * {scale!r}D AS reach")
        .selectExpr("*", f"reach * {1.0 + 1e-9!r}D AS __r")
        .selectExpr(
            "*",
            "struct(mx - __r AS minx, mz - __r AS miny, mx + __r AS maxx, mz + __r AS maxy) AS __around",
        )
        .drop("__r")
    )
    eyes = views.selectExpr("*", "struct(ex AS minx, ez AS miny, ex AS maxx, ez AS maxy) AS __eye")
    pairs = overlap_join(eyes, reached, "__eye", "__around", left_points=True)
    return (
        pairs.drop("__eye", "__around")
        .selectExpr("*", f"{_DISTANCE} AS distance")
        .where("distance <= reach")
    )


def desired_resolution(pairs: DataFrame, fov_deg: float = 55.0, viewport_h: float = 900.0) -> DataFrame:
    """Add ``desired``: point spacing in metres a tile needs for a view, 0 to leave it.

    ``pairs`` comes from :func:`views_tiles`.
    """
    facing = " + ".join(
        f"f{k} * abs(get(a{k}, 0) * (mx - ex) + get(a{k}, 1) * (my - ey) + get(a{k}, 2) * (mz - ez))"
        for k in (1, 2, 3)
    )
    scale = pixels_per_unit(fov_deg, viewport_h)
    points = f"least(greatest(area_px / {PIXELS_PER_POINT}D, {MIN_POINTS}D), {MAX_POINTS}D)"
    area = f"({facing}) * {scale * scale!r}D / pow(greatest(distance, 1e-6D), 3D)"
    return (
        # Through a one-element generator: a later filter on ``desired`` is then
        # not rewritten into the join condition with a copy of the area in
        # each of its terms.
        pairs.selectExpr("*", f"inline(array(struct({area} AS area_px)))")
        .selectExpr("*", f"sqrt(tile_area / {points}) AS __res")
        .selectExpr(
            *pairs.columns,
            "area_px",
            f"CASE WHEN point_count = 0 OR area_px < {PIXELS_PER_POINT}D OR __res > {COARSEST}D THEN 0D"
            f" ELSE greatest(__res, {FINEST}D) END AS desired",
        )
    )


def refine_plan(wanted: DataFrame) -> DataFrame:
    """(view, tile) pairs whose loaded resolution is too coarse."""
    return wanted.where(
        (F.col("point_count") > 0)
        & (F.col("desired") > 0)
        & (F.col("loaded") > F.col("desired") * REFINE_FACTOR)
    )


def refine_topk(plan: DataFrame, k: int) -> DataFrame:
    """The first ``k`` tiles of each view in tile order (cloud, row, column)."""
    order = Window.partitionBy("view_id").orderBy("file_id", "gy", "gx")
    return plan.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_coarse_resolution(tiles: DataFrame) -> DataFrame:
    """Add ``loaded``, the resolution of a first pass over all tiles."""
    return tiles.withColumn("loaded", coarse_resolution("tile_area"))


def with_eye(views: DataFrame) -> DataFrame:
    """Add the eye of views given by target tx, ty, tz, yaw, pitch and distance."""
    eye = view_position("tx", "ty", "tz", "yaw", "pitch", "view_distance")
    for name, column in eye.items():
        views = views.withColumn(name, column)
    return views


def view_frustum(
    views: DataFrame, tiles: DataFrame, fov_deg: float, aspect: float, near: float, far: float
) -> DataFrame:
    """Pairs of a view and a tile box not entirely beyond one clip plane.

    A box is beyond a plane when its farthest corner along the plane's normal
    is; that corner is picked per axis, so no corner rows are needed. A kept
    box lies within a bound of the eye that follows from the far plane, which
    turns the pairing into an overlap join.
    """
    ty = math.tan(math.radians(fov_deg) * 0.5)
    tx = ty * aspect
    widest = math.sqrt(1.0 + tx * tx + ty * ty)
    side = [f"(box.hi{k} - box.lo{k})" for k in "xyz"]
    grow = f"sqrt({' + '.join(f'{v} * {v}' for v in side)}) * {widest + 1.4143!r}D"
    boxed = (
        spread(tiles, "file_id", "gx", "gy")
        .selectExpr("*", f"{grow} AS __grow")
        .selectExpr(
            "*",
            "struct(box.lox - __grow AS minx, box.loz - __grow AS miny,"
            " box.hix + __grow AS maxx, box.hiz + __grow AS maxy) AS __around",
        )
        .drop("__grow")
    )
    bound = f"{far * widest * (1.0 + 1e-9)!r}D"
    forward = ("(-cos(pitch) * sin(yaw))", "(-sin(pitch))", "(-cos(pitch) * cos(yaw))")
    right = ("cos(yaw)", "0D", "(-sin(yaw))")
    up = ("(-sin(pitch) * sin(yaw))", "cos(pitch)", "(-sin(pitch) * cos(yaw))")

    def blend(axis: tuple[str, ...], sign: str, slope: float) -> list[str]:
        return [f"{sign}{a} + {slope!r}D * {f}" for a, f in zip(axis, forward, strict=True)]

    # Inward normal and limit of each plane, per view: a point p is inside
    # when normal . (p - eye) >= limit.
    planes = [
        (list(forward), near),
        ([f"-{f}" for f in forward], -far),
        (blend(right, "", tx), 0.0),
        (blend(right, "-", tx), 0.0),
        (blend(up, "", ty), 0.0),
        (blend(up, "-", ty), 0.0),
    ]
    normals = [
        f"{part} AS __n{i}{k}"
        for i, (normal, _) in enumerate(planes)
        for k, part in zip("xyz", normal, strict=True)
    ]
    limits = [
        f"{float(limit)!r}D + __n{i}x * ex + __n{i}y * ey + __n{i}z * ez AS __limit{i}"
        for i, (_, limit) in enumerate(planes)
    ]
    eyes = (
        views.selectExpr(
            "*",
            f"struct(ex - {bound} AS minx, ez - {bound} AS miny, ex + {bound} AS maxx, ez + {bound} AS maxy) AS __eye",
            *normals,
        )
        .selectExpr("*", *limits)
    )
    pairs = overlap_join(eyes, boxed, "__eye", "__around")
    visible = " AND ".join(
        " + ".join(f"greatest(__n{i}{k} * box.lo{k}, __n{i}{k} * box.hi{k})" for k in "xyz")
        + f" >= __limit{i}"
        for i in range(len(planes))
    )
    return pairs.where(visible).select(*views.columns, *tiles.columns)


def screen_thin(
    points: DataFrame,
    views: DataFrame,
    fov_deg: float = 55.0,
    viewport_h: float = 900.0,
    pixel_spacing: float = 2.83,
) -> DataFrame:
    """Points of each cloud kept for the cloud's view, about one per pixel spacing.

    ``points``: file_id, gx, gy, gz (scene) and density; ``views``: file_id,
    eye and angles. The choice depends on the position only, so it is stable.
    """
    # Both sides bring what they can work out alone: as part of the join's
    # condition it would be evaluated term by term, again for each use.
    forward = view_axes("yaw", "pitch")["forward"]
    eyes = views.withColumns({f"__f{k}": v for k, v in zip("xyz", forward, strict=True)})
    hashed = points.withColumn("__hash", fine_hash("gx", "gy", "gz"))
    joined = join_catalog(hashed, eyes, "file_id", ["gx", "gy", "gz"])
    depth = (
        (F.col("gx") - F.col("ex")) * F.col("__fx")
        + (F.col("gy") - F.col("ey")) * F.col("__fy")
        + (F.col("gz") - F.col("ez")) * F.col("__fz")
    )
    keep = keep_probability("density", depth, fov_deg, viewport_h, pixel_spacing)
    kept = joined.withColumn("depth_in_view", depth).where(F.col("__hash") <= keep)
    return kept.drop("__hash", "__fx", "__fy", "__fz")
