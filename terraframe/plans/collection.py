"""A terrain collection derived from the driver's tables.

One cloud, one set of rasters and one view per supplier, laid out side by
side on a 32-wide mosaic of 250 m squares, so that all of it grows with the
tables.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.functions.frame import geo_struct, raster_extent, to_scene, world_to_pixel
from terraframe.operators.catalog import as_scalar, scene_frame
from terraframe.operators.lod import with_eye
from terraframe.operators.lookup import join_catalog
from terraframe.operators.points import (
    assign_depth,
    cloud_bounds,
    point_spacing,
    points_to_tiles,
    tile_boxes,
    tile_pca,
)
from terraframe.operators.raster import fill_nearest, fit_whole, grid_pixels, points_to_raster
from terraframe.session import shared_dir, stored
from terraframe.sources.tables import write_lod_points

SQUARE = 250.0
ACROSS = 32


class Collection:
    """Lazy DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._kept: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}

    def once(self, name: str, make) -> DataFrame:
        """A derived table that several steps look at: written once a collection."""
        if name not in self._kept:
            self._kept[name] = stored(make())
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def points(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_suppkey AS file_id",
            "cast(((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 64"
            " + floor(l_quantity) AS bigint) AS file_idx",
            f"cast(l_suppkey % {ACROSS} AS double) * {SQUARE}D + cast(l_orderkey % 997 AS double) * 0.25D"
            " + l_linenumber * 0.01D AS x",
            f"cast(floor(l_suppkey / {ACROSS}) AS double) * {SQUARE}D"
            " + cast(l_partkey % 499 AS double) * 0.5D AS y",
            "l_quantity + l_discount * 10D AS z",
            "cast(l_orderkey * 37 % 65536 AS int) AS red",
            "cast(l_partkey * 101 % 65536 AS int) AS green",
            "cast(l_suppkey * 977 % 65536 AS int) AS blue",
        )

    @cached_property
    def bounds(self) -> DataFrame:
        return self.once("bounds", lambda: cloud_bounds(self.points))

    @cached_property
    def frame(self) -> DataFrame:
        return scene_frame(self.bounds)

    def in_scene(self, df: DataFrame) -> DataFrame:
        """Attach the frame as one struct column: a scalar subquery, evaluated once."""
        return df.withColumn("frame", as_scalar(self.frame))

    @cached_property
    def squares(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey AS raster_id",
            f"cast(s_suppkey % {ACROSS} AS double) * {SQUARE}D AS x0",
            f"cast(floor(s_suppkey / {ACROSS}) AS double) * {SQUARE}D AS y0",
        )

    def raster_catalog(self, pixel: float, inset: float, size: int) -> DataFrame:
        """One north-up raster per supplier, its first pixel centre ``inset`` from the corner."""
        zero = F.lit(0.0)
        return self.squares.select(
            "raster_id",
            F.lit(pixel).alias("a"),
            zero.alias("b"),
            (F.col("x0") + inset).alias("c"),
            zero.alias("d"),
            F.lit(-pixel).alias("e"),
            (F.col("y0") + (SQUARE - inset)).alias("f"),
            F.lit(size).alias("width"),
            F.lit(size).alias("height"),
        )

    @cached_property
    def dsm_catalog(self) -> DataFrame:
        return self.raster_catalog(10.0, 5.0, 25)

    @cached_property
    def dtm_catalog(self) -> DataFrame:
        return self.raster_catalog(25.0, 12.5, 10)

    @cached_property
    def dhm_catalog(self) -> DataFrame:
        return self.raster_catalog(12.5, 6.25, 20)

    @cached_property
    def image_catalog(self) -> DataFrame:
        return self.raster_catalog(5.0, 7.5, 46)

    def _rasterise(self, points: DataFrame, catalog: DataFrame, how: str) -> DataFrame:
        keyed = points.select(F.col("file_id").alias("raster_id"), "x", "y", "z")
        return points_to_raster(keyed, catalog, how)

    @cached_property
    def dsm(self) -> DataFrame:
        return self._rasterise(self.points, self.dsm_catalog, "max")

    @cached_property
    def dtm(self) -> DataFrame:
        return self._rasterise(self.points, self.dtm_catalog, "min")

    @cached_property
    def dhm(self) -> DataFrame:
        """Heights around zero, some below: the fractional part of z around 0.3."""
        heights = self.points.withColumn("z", F.col("z") - F.floor("z") - 0.3)
        return self._rasterise(heights, self.dhm_catalog, "max")

    @cached_property
    def dsm_filled(self) -> DataFrame:
        return fill_nearest(self.dsm, whole=fit_whole(self.dsm_catalog))

    @cached_property
    def dtm_filled(self) -> DataFrame:
        return fill_nearest(self.dtm, whole=fit_whole(self.dtm_catalog))

    @cached_property
    def image(self) -> DataFrame:
        s, r, c = F.col("raster_id"), F.col("row"), F.col("col")
        return grid_pixels(self.image_catalog).select(
            "raster_id",
            "row",
            "col",
            ((r * 7 + c * 13 + s * 29) % 256).cast("int").alias("r"),
            ((r * 11 + c * 5 + s * 31) % 256).cast("int").alias("g"),
            ((r * 3 + c * 17 + s * 37) % 256).cast("int").alias("b"),
            F.lit(255).alias("a"),
        )

    def image_positions(self, points: DataFrame) -> DataFrame:
        """Points with their fractional pixel in their cloud's image."""
        keyed = points.withColumn("raster_id", F.col("file_id"))
        joined = join_catalog(keyed, self.image_catalog, "raster_id", ["file_idx"])
        pixel = world_to_pixel("x", "y", geo_struct())
        return (
            joined.withColumn("px", pixel["px"])
            .withColumn("py", pixel["py"])
            .drop(*"abcdef")
        )

    def boxes(self, catalog: DataFrame, key: str, name: str) -> DataFrame:
        box = raster_extent(geo_struct(), "width", "height")
        return catalog.select(
            F.col("raster_id").alias(key), F.struct(*(v.alias(k) for k, v in box.items())).alias(name)
        )

    @cached_property
    def tiled(self) -> DataFrame:
        return points_to_tiles(self.points, self.bounds)

    def lod_table(self, spacing: float, depths: int) -> str:
        """Path of the points' multi-resolution table, written once a collection."""
        path = f"{shared_dir(self.spark).rstrip('/')}/tables/lod-{uuid.uuid4().hex}"
        if "lod" not in self._paths:
            leveled = assign_depth(points_to_tiles(self.points, self.bounds), self.bounds, spacing, depths)
            write_lod_points(leveled, path)
            self._paths["lod"] = path
        return self._paths["lod"]

    @cached_property
    def scene_points(self) -> DataFrame:
        """Points with scene coordinates gx (east), gy (up), gz (south)."""
        scene = to_scene("x", "y", "z", F.col("frame"))
        return self.in_scene(self.points).withColumns(scene).drop("frame")

    @cached_property
    def scene_tiles(self) -> DataFrame:
        """Occupied tiles in scene coordinates with their principal box, 4 x 4 per cloud."""
        n = 4
        tiled = points_to_tiles(self.points, self.bounds, n)
        scene = to_scene("x", "y", "z", F.col("frame"))
        placed = self.in_scene(tiled).select(
            "file_id", "gx", "gy", *(scene[k].alias(a) for k, a in (("gx", "x"), ("gy", "z"), ("gz", "y")))
        )
        # The moments only need the three axes in order east, up, south.
        pca = tile_pca(placed, ("x", "z", "y"))
        boxes = tile_boxes(self.bounds, n).select("file_id", "gx", "gy", "tile", "tile_w", "tile_h")
        joined = self.in_scene(pca.join(boxes, ["file_id", "gx", "gy"]))
        return joined.select(
            "file_id",
            "gx",
            "gy",
            "point_count",
            F.expr("tile_w * tile_h").alias("tile_area"),
            *(f"{v}{k}" for v in ("e", "a") for k in (1, 2, 3)),
            point_spacing(F.col("e1"), F.col("e2"), F.col("point_count")).alias("spacing"),
            F.expr(
                "struct((tile.minx - frame.cx) / frame.scale AS lox, minz AS loy,"
                " -(tile.maxy - frame.cy) / frame.scale AS loz,"
                " (tile.maxx - frame.cx) / frame.scale AS hix, maxz AS hiy,"
                " -(tile.miny - frame.cy) / frame.scale AS hiz)"
            ).alias("box"),
        )

    @cached_property
    def views(self) -> DataFrame:
        """One view per supplier, orbiting the middle of its square; scene units."""
        views = self.in_scene(self.squares).selectExpr(
            "raster_id AS view_id",
            "(x0 + 125D - frame.cx) / frame.scale AS tx",
            "(25D - frame.cz) / frame.scale AS ty",
            "-(y0 + 125D - frame.cy) / frame.scale AS tz",
            "raster_id * 0.7D AS yaw",
            "0.2D + (raster_id % 10) * 0.1D AS pitch",
            "(40D + (raster_id % 7) * 30D) / frame.scale AS view_distance",
        )
        return with_eye(views)
