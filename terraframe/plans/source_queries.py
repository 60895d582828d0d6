"""Queries through files: the readers and writers, on data derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraframe.functions.crs import horizontal_epsg
from terraframe.operators import points as P
from terraframe.operators import raster as R
from terraframe.operators.blocks import to_blocks
from terraframe.plans import fixture_files as files
from terraframe.plans.collection import Collection
from terraframe.plans.point_queries import _LOD_CTE, DEPTHS, SPACING
from terraframe.plans.registry import fixed_as, query
from terraframe.plans.sql import fixed as q, with_sql
from terraframe.sources import read_lod_points, read_world_files, register, write_lod_points, write_tables


def _las_folder(c: Collection) -> str:
    register(c.spark)
    folder = files.scratch(c.spark, "las")
    files.write_las(c.points, folder)
    return folder


def _stored(k: str) -> str:
    return f"floor({k}/0.01e0 + 0.5e0)*0.01e0"


@query(
    "las_points",
    with_sql("pts")
    + f"""SELECT {q(_stored('x'))} AS x, {q(_stored('y'))} AS y, {q(_stored('z'))} AS z, red, green, blue FROM pts""",
)
def _(c: Collection):
    points = c.spark.read.format("las").load(_las_folder(c))
    return points.select(*fixed_as(x="x", y="y", z="z"), "red", "green", "blue")


@query(
    "las_catalog",
    with_sql("pts")
    + "SELECT 2 AS format_id, 2154 AS epsg, CAST(count(*) AS BIGINT) AS points, "
    + ", ".join(f"{q(f'{m}({_stored(k)})')} AS {m}{k}" for m in ("min", "max") for k in "xyz")
    + " FROM pts",
)
def _(c: Collection):
    catalog = c.spark.read.format("las").option("header_only", "true").load(_las_folder(c))
    names = {m + k: (F.min if m == "min" else F.max)(m + k) for m in ("min", "max") for k in "xyz"}
    return catalog.groupBy("format_id", horizontal_epsg("wkt").alias("epsg")).agg(
        F.sum("point_count").alias("points"), *fixed_as(**names)
    )


def _dem_folder(c: Collection) -> str:
    register(c.spark)
    folder = files.scratch(c.spark, "dem")
    files.write_geotiffs(to_blocks(c.dsm, ["v"]), c.dsm_catalog, folder)
    return folder


@query(
    "dem_pixels",
    with_sql("dsm") + f"SELECT raster_id, row, col, {q('CAST(CAST(v AS FLOAT) AS DOUBLE)')} AS v FROM dsm",
)
def _(c: Collection):
    folder = _dem_folder(c)
    number = F.regexp_extract("path", r"dem-(\d+)\.tif$", 1).cast("long").alias("raster_id")
    catalog = c.spark.read.format("geotiff").option("header_only", "true").load(folder).select("*", number)
    raw = c.spark.read.format("geotiff").load(folder).select(
        number, "row", "col", F.col("band1").alias("v")
    )
    return R.dem_pixels(raw, catalog).select("raster_id", "row", "col", *fixed_as(v="v"))


@query(
    "dem_catalog",
    with_sql("dsm_catalog")
    + f"""SELECT raster_id, width, height, 1 AS bands, {q('a')} AS a, {q('c')} AS c, {q('e')} AS e, {q('f')} AS f,
      {q('-9999e0')} AS nodata, 2154 AS epsg FROM dsm_catalog""",
)
def _(c: Collection):
    catalog = c.spark.read.format("geotiff").option("header_only", "true").load(_dem_folder(c))
    number = F.regexp_extract("path", r"dem-(\d+)\.tif$", 1).cast("long").alias("raster_id")
    return catalog.select(
        number, "width", "height", "bands", *fixed_as(a="a", c="c", e="e", f="f", nodata="nodata"), "epsg"
    )


@query(
    "world_file",
    with_sql("dsm_catalog")
    + f"SELECT raster_id, {', '.join(f'{q(k)} AS {k}' for k in 'abcdef')} FROM dsm_catalog",
)
def _(c: Collection):
    folder = files.scratch(c.spark, "world")
    files.write_world_files(c.dsm_catalog, folder)
    number = F.regexp_extract("path", r"dem-(\d+)\.tfw$", 1).cast("long").alias("raster_id")
    return read_world_files(c.spark, folder).select(number, *fixed_as(**{k: k for k in "abcdef"}))


@query(
    "lod_read",
    with_sql("lod", extra=_LOD_CTE)
    + f"""SELECT file_id, CAST(depth AS INTEGER) AS depth, count(*) AS points, {q('sum(z)')} AS sum_z
      FROM lod WHERE depth <= 2 GROUP BY file_id, depth""",
)
def _(c: Collection):
    """Written by depth, then read for 10 m: folders beyond depth 2 are not scanned."""
    leveled = P.points_to_tiles(P.assign_depth(c.points, c.bounds, SPACING, DEPTHS), c.bounds)
    folder = files.scratch(c.spark, "lod")
    write_lod_points(leveled, folder)
    found = read_lod_points(c.spark, folder, SPACING, DEPTHS, 10.0)
    return found.groupBy("file_id", "depth").agg(
        F.count(F.lit(1)).alias("points"), *fixed_as(sum_z=F.sum("z"))
    )


@query(
    "write_tables",
    with_sql("tiled")
    + f"SELECT gx, gy, count(*) AS points, {q('min(x)')} AS minx, {q('max(z)')} AS maxz FROM tiled GROUP BY gx, gy",
)
def _(c: Collection):
    folder = files.scratch(c.spark, "tiles")
    write_tables(c.tiled, folder, ["gx"], ["gy", "file_id"])
    found = c.spark.read.parquet(folder)
    return found.groupBy("gx", "gy").agg(
        F.count(F.lit(1)).alias("points"), *fixed_as(minx=F.min("x"), maxz=F.max("z"))
    )
