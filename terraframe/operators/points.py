"""Point-cloud operators. A cloud is (file_id, file_idx, x, y, z[, red, green, blue])."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraframe.functions.numeric import clamp
from terraframe.operators.lookup import join_catalog
from terraframe.operators.sampling import sample_image

# Fixed value: tiles per side.
TILES = 8


def cloud_bounds(points: DataFrame) -> DataFrame:
    """One row per cloud: count and extent."""
    return points.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("point_count"),
        *(F.min(c).alias(f"min{c}") for c in "xyz"),
        *(F.max(c).alias(f"max{c}") for c in "xyz"),
    )


def thin_grid(bounds: DataFrame, target: int) -> DataFrame:
    """Per cloud: cell size and cell counts of the thinning grid; ``thin`` if it applies."""
    dx, dy = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    first = F.greatest(F.sqrt(F.greatest(dx * dy, F.lit(1e-12)) / F.lit(float(target))), F.lit(1e-9))

    def cells(length: Column) -> Column:
        return F.greatest(F.floor(length / F.col("__cell")) + 1, F.lit(1)).cast("long")

    return (
        bounds.withColumn("thin", F.col("point_count") > target)
        .withColumn("__cell", first)
        .withColumn("grid_x", cells(dx))
        .withColumn("grid_y", cells(dy))
        .withColumn(
            "cell", F.greatest(dx / F.col("grid_x"), dy / F.col("grid_y"), F.lit(1e-9))
        )
        .select("file_id", "minx", "miny", "thin", "grid_x", "grid_y", "cell")
    )


def thin_cells(points: DataFrame, bounds: DataFrame, target: int) -> DataFrame:
    """Points with their thinning cell (cx, cy).

    Points beyond the declared extent fall in the border cells. A cloud that
    needs no thinning gets one cell per point.
    """
    grid = thin_grid(bounds, target)
    drop = [c for c in grid.columns if c not in points.columns]

    def axis(v: str, low: str, count: str) -> Column:
        return clamp(F.floor((F.col(v) - F.col(low)) / F.col("cell")), 0, F.col(count) - 1)

    return (
        join_catalog(points, grid, "file_id", ["file_idx"])
        .withColumn(
            "cx", F.when(F.col("thin"), axis("x", "minx", "grid_x")).otherwise(F.col("file_idx"))
        )
        .withColumn("cy", F.when(F.col("thin"), axis("y", "miny", "grid_y")).otherwise(F.lit(-1)))
        .drop(*drop)
    )


def first_in_cell(celled: DataFrame, keys: list[str]) -> DataFrame:
    """The first point of each cell in file order.

    One ``min_by`` per column rather than one over a struct: the buffers are
    then fixed-size, so Spark aggregates by hash on the map side and a dense
    cell costs one row per task, without sorting its points.
    """
    payload = [c for c in celled.columns if c not in keys and c != "file_idx"]
    return celled.groupBy(*keys).agg(
        F.min("file_idx").alias("file_idx"),
        *(F.min_by(c, "file_idx").alias(c) for c in payload),
    )


def grid_thin(points: DataFrame, bounds: DataFrame, target: int) -> DataFrame:
    """Clouds above ``target`` points reduced to the first point of each grid cell."""
    kept = first_in_cell(thin_cells(points, bounds, target), ["file_id", "cx", "cy"])
    return kept.select(*points.columns)


def file_order(points: DataFrame) -> DataFrame:
    """Points in file order; a range sort, only for consumers that need it."""
    return points.orderBy("file_id", "file_idx")


def assign_depth(
    points: DataFrame, bounds: DataFrame, spacing: float, max_depth: int
) -> DataFrame:
    """Multi-resolution depth of each point, 0 to ``max_depth`` (at least 1).

    The points of depth <= d are exactly the first points, in file order, of
    the cells of size ``spacing / 2^d``; what no coarser level takes gets
    ``max_depth``. The grids are nested, so a cell's first point is the first
    of its own finer cell too and every level can be found independently:
    no level waits for the one above.
    """
    corner = bounds.selectExpr("file_id", "minx AS __x0", "miny AS __y0")
    finest = 2.0 ** (max_depth - 1)
    # Points are reduced to the heads of the finest grid first; the coarser
    # levels are then found among those.
    heads = (
        join_catalog(
            points.select("file_id", "file_idx", "x", "y"), corner, "file_id", ["file_idx"]
        )
        .groupBy(
            "file_id",
            F.expr(f"floor((x - __x0) / {float(spacing)!r}D * {finest!r}D)").alias("cx"),
            F.expr(f"floor((y - __y0) / {float(spacing)!r}D * {finest!r}D)").alias("cy"),
        )
        .agg(F.min("file_idx").alias("file_idx"))
    )
    # The heads of a coarsest cell (4^(max_depth - 1) at most) meet once, in
    # one partition, sorted once for all levels; no head is multiplied or sent
    # on for the levels between.
    levels = range(max_depth - 1)
    heads = heads.selectExpr("*", *(f"shiftright(c{v}, {max_depth - 1 - d}) AS __{v}{d}" for d in levels for v in "xy"))
    cells, depth = ["file_id", *(f"__{v}{d}" for d in levels for v in "xy")], f"{max_depth - 1}"
    if levels:
        heads = heads.repartition(*cells[:3]).sortWithinPartitions(*cells)
    for d in levels:
        heads = heads.withColumn(f"__first{d}", F.min("file_idx").over(Window.partitionBy(*cells[: 3 + 2 * d])))
    for d in reversed(levels):
        depth = f"CASE WHEN file_idx = __first{d} THEN {d} ELSE {depth} END"
    heads = heads.selectExpr("file_id", "file_idx", f"{depth} AS __depth")
    return points.join(heads, ["file_id", "file_idx"], "left").selectExpr(
        *points.columns, f"cast(coalesce(__depth, {max_depth}) AS int) AS depth"
    )


def tile_boxes(bounds: DataFrame, n: int = TILES) -> DataFrame:
    """The n x n tiles of each cloud's extent."""
    index = F.sequence(F.lit(0), F.lit(n - 1))
    w = (F.col("maxx") - F.col("minx")) / n
    h = (F.col("maxy") - F.col("miny")) / n
    x0 = F.col("minx") + F.col("gx") * F.col("tile_w")
    y0 = F.col("miny") + F.col("gy") * F.col("tile_h")
    return (
        bounds.withColumn("tile_w", w)
        .withColumn("tile_h", h)
        .withColumn("gx", F.explode(index))
        .withColumn("gy", F.explode(index))
        .select(
            "file_id",
            "gx",
            "gy",
            F.struct(
                x0.alias("minx"),
                y0.alias("miny"),
                F.when(F.col("gx") == n - 1, F.col("maxx")).otherwise(x0 + F.col("tile_w")).alias("maxx"),
                F.when(F.col("gy") == n - 1, F.col("maxy")).otherwise(y0 + F.col("tile_h")).alias("maxy"),
            ).alias("tile"),
            "tile_w",
            "tile_h",
            "minz",
            "maxz",
            F.col("maxx").alias("cloud_maxx"),
            F.col("maxy").alias("cloud_maxy"),
        )
    )


def points_to_tiles(points: DataFrame, bounds: DataFrame, n: int = TILES) -> DataFrame:
    """Points with their tile (gx, gy); points beyond the extent are in none.

    The tile is computed, not joined. A quotient can land on the other side
    of a border than ``min + g * width`` does, so the neighbours are checked.
    """
    corner = bounds.select(
        "file_id", *(F.col(c).alias(f"__{c}") for c in ("minx", "miny", "maxx", "maxy"))
    )

    def guess(v: str) -> str:
        w = f"((__max{v} - __min{v}) / {n})"
        g = f"greatest(least(floor(({v} - __min{v}) / {w}), {n - 1}), 0)"
        return f"CASE WHEN {w} > 0 THEN {g} ELSE {n - 1} END AS __g{v}"

    def settle(v: str) -> str:
        w = f"((__max{v} - __min{v}) / {n})"
        return (
            f"cast(CASE WHEN __g{v} > 0 AND {v} < __min{v} + __g{v} * {w} THEN __g{v} - 1"
            f" WHEN __g{v} < {n - 1} AND {v} >= __min{v} + (__g{v} + 1) * {w} THEN __g{v} + 1"
            f" ELSE __g{v} END AS int) AS g{v}"
        )

    inside = "x >= __minx AND x <= __maxx AND y >= __miny AND y <= __maxy"
    return (
        join_catalog(points, corner, "file_id", ["x", "y"])
        .where(inside)
        .selectExpr("*", guess("x"), guess("y"))
        .selectExpr(*points.columns, settle("x"), settle("y"))
    )


TILE_KEYS = ["file_id", "gx", "gy"]


def tile_stats(tiled: DataFrame) -> DataFrame:
    """Point count and vertical range of each occupied tile."""
    return tiled.groupBy(*TILE_KEYS).agg(
        F.count(F.lit(1)).alias("point_count"), F.min("z").alias("minz"), F.max("z").alias("maxz")
    )


def tile_pca(tiled: DataFrame, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Count, mean, covariance, principal extents and axes of each tile.

    Six mergeable moments are aggregated on the JVM side, map side first; the
    3x3 eigenproblem is then solved for batches of tiles, one row each.
    """
    a, b, c = axes
    moments = tiled.groupBy(*TILE_KEYS).agg(
        F.count(F.lit(1)).alias("point_count"),
        F.min("z").alias("minz"),
        F.max("z").alias("maxz"),
        *(F.avg(v).alias(f"mean_{i}") for i, v in enumerate(axes)),
        F.var_pop(a).alias("c00"),
        F.covar_pop(a, b).alias("c01"),
        F.covar_pop(a, c).alias("c02"),
        F.var_pop(b).alias("c11"),
        F.covar_pop(b, c).alias("c12"),
        F.var_pop(c).alias("c22"),
    )
    return principal_axes(moments)


def principal_axes(moments: DataFrame) -> DataFrame:
    """Add eigenvalues l1 >= l2 >= l3, extents e1..e3 and unit axes a1..a3.

    The sign of an axis is chosen so that its largest component is positive.
    Repeated eigenvalues get one valid set of axes.
    """
    frame = principal_frame("c00", "c01", "c02", "c11", "c12", "c22")
    return moments.withColumn("__f", frame).selectExpr(
        *moments.columns,
        *(f"get(__f, {k - 1}) AS l{k}" for k in (1, 2, 3)),
        *(f"sqrt(greatest(0D, get(__f, {k - 1}))) AS e{k}" for k in (1, 2, 3)),
        *(f"slice(__f, {3 * k + 1}, 3) AS a{k}" for k in (1, 2, 3)),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def principal_frame(
    c00: pd.Series, c01: pd.Series, c02: pd.Series, c11: pd.Series, c12: pd.Series, c22: pd.Series
) -> pd.Series:
    """Eigenvalues of each covariance, largest first, and their three unit vectors."""
    rows = [[c00, c01, c02], [c01, c11, c12], [c02, c12, c22]]
    matrices = np.stack([np.stack([c.to_numpy(float) for c in r], axis=-1) for r in rows], axis=-2)
    values, columns = np.linalg.eigh(matrices)
    vectors = columns[:, :, ::-1].transpose(0, 2, 1)
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=2)[:, :, None], axis=2)
    signed = vectors * np.where(largest < 0, -1.0, 1.0)
    return pd.Series(list(np.hstack([values[:, ::-1], signed.reshape(-1, 9)])))


def point_spacing(e1: Column, e2: Column, count: Column) -> Column:
    """Spacing of points spread over the two larger principal extents."""
    return F.sqrt(F.greatest(e1 * e2 * 12.0, F.lit(1e-12)) / count)


def cloud_density(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points per plan area of each cloud, 1 for a degenerate area."""
    area = (F.max(x) - F.min(x)) * (F.max(y) - F.min(y))
    return (
        points.groupBy("file_id")
        .agg(F.count(F.lit(1)).alias("point_count"), area.alias("area"))
        .withColumn(
            "density",
            F.when(F.col("area") > 1e-12, F.col("point_count") / F.col("area")).otherwise(1.0),
        )
    )


def colorize_points(points: DataFrame, image_blocks: DataFrame) -> DataFrame:
    """Image colour at points (raster_id, px, py, width, height), grey outside."""
    return sample_image(points, image_blocks)


def outside_count(coloured: DataFrame) -> DataFrame:
    """Points outside the image, per cloud."""
    return coloured.groupBy("file_id").agg(
        F.count_if(F.col("outside")).alias("outside_points"),
        F.count(F.lit(1)).alias("point_count"),
    )


def tile_partition_check(points: DataFrame, tiled: DataFrame) -> DataFrame:
    """Points lost by tiling or put in more than one tile; empty when all is well.

    One aggregation over both sides instead of two set differences.
    """
    keys = ["file_id", "file_idx"]
    both = points.select(*keys, F.lit(1).alias("given"), F.lit(0).alias("tiled")).unionByName(
        tiled.select(*keys, F.lit(0).alias("given"), F.lit(1).alias("tiled"))
    )
    return (
        both.groupBy(*keys)
        .agg(F.sum("given").alias("given"), F.sum("tiled").alias("tiled"))
        .where(F.col("given") != F.col("tiled"))
    )
