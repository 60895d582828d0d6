"""Queries on rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions import colour, frame, rules
from terraframe.functions.crs import cone_constants, reproject_batches, resolve
from terraframe.operators import raster as R
from terraframe.operators.blocks import to_blocks
from terraframe.operators.boxes import box, overlap_join
from terraframe.operators.catalog import as_scalar
from terraframe.operators.lookup import join_catalog
from terraframe.operators.sampling import sample_image
from terraframe.plans.collection import Collection
from terraframe.plans.point_queries import _CONE, _project_sql
from terraframe.plans.registry import fixed, fixed_as, query
from terraframe.plans.sql import (
    NEIGHBOURS,
    STOPS3,
    fixed as q,
    ground,
    on_raster,
    pixel_of,
    ramp,
    resample,
    with_sql,
)

PIXEL = ["raster_id", "row", "col"]


def _same_id(c: Collection) -> DataFrame:
    return c.squares.select(F.col("raster_id").alias("grid_id"), F.col("raster_id").alias("source_id"))


def dsm_with_ground(c: Collection) -> DataFrame:
    return R.resample_grid(c.dsm, c.dtm, _same_id(c), c.dsm_catalog, c.dtm_catalog)


def dhm_with_ground(c: Collection) -> DataFrame:
    return R.resample_grid(c.dhm, c.dtm, _same_id(c), c.dhm_catalog, c.dtm_catalog)


def ground_with_dsm(c: Collection) -> DataFrame:
    return R.resample_grid(c.dtm, c.dsm, _same_id(c), c.dtm_catalog, c.dsm_catalog)


def ground_with_dhm(c: Collection) -> DataFrame:
    return R.resample_grid(c.dtm, c.dhm, _same_id(c), c.dtm_catalog, c.dhm_catalog)


# --- scalar ---------------------------------------------------------------


@query(
    "pixel_to_world",
    with_sql("dsm", "dsm_catalog")
    + f"""SELECT p.raster_id, p.row, p.col, {q('k.c + k.a*p.col + 0.5e0*p.row')} AS x,
      {q('k.f + 0.25e0*p.col + k.e*p.row')} AS y FROM dsm p JOIN dsm_catalog k USING (raster_id)""",
)
def _(c: Collection):
    sheared = c.dsm_catalog.withColumn("b", F.lit(0.5)).withColumn("d", F.lit(0.25))
    joined = join_catalog(c.dsm, sheared, "raster_id", ["row", "col"])
    return joined.select(*PIXEL, *fixed_as(**frame.pixel_to_world("col", "row", frame.geo_struct())))


_W2P = pixel_of("p.x", "p.y", "k")


@query(
    "world_to_pixel",
    with_sql("pts", "k", extra={"k": "SELECT raster_id, a, 0.5e0 AS b, c, 0.25e0 AS d, e, f FROM dsm_catalog"})
    + f"""SELECT p.file_id, p.file_idx, {q(_W2P[0])} AS px, {q(_W2P[1])} AS py
      FROM pts p JOIN k ON k.raster_id = p.file_id""",
)
def _(c: Collection):
    sheared = c.dsm_catalog.withColumn("b", F.lit(0.5)).withColumn("d", F.lit(0.25))
    joined = join_catalog(c.points, sheared.withColumnRenamed("raster_id", "file_id"), "file_id", ["file_idx"])
    pixel = frame.world_to_pixel("x", "y", frame.geo_struct())
    return joined.select("file_id", "file_idx", *fixed_as(**pixel))


@query(
    "is_nodata",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey,
      CASE l_suppkey % 3 WHEN 0 THEN l_quantity - 25e0 < -9000e0
        WHEN 1 THEN abs(l_quantity - 25e0) < 1e-3 ELSE
        CASE WHEN l_partkey % 10 = 0 THEN -9999e0 ELSE l_quantity END < -9000e0 END AS nodata FROM lineitem""",
)
def _(c: Collection):
    s = F.col("l_suppkey") % 3
    value = F.when(s == 2, F.when(F.col("l_partkey") % 10 == 0, -9999.0).otherwise(F.col("l_quantity"))).otherwise(
        F.col("l_quantity")
    )
    declared = F.when(s == 0, F.lit(-9999.0)).when(s == 1, F.lit(25.0))
    value = F.when(s == 0, F.col("l_quantity") - 25.0).otherwise(value)
    return c.table("lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", rules.is_nodata(value, declared).alias("nodata")
    )


@query(
    "terrain_rgb",
    with_sql("image")
    + f"""SELECT raster_id, row, col, CASE WHEN (r%3*65536 + g*256 + b)*0.1e0 - 10000e0 >= -9000e0
      THEN {q('(r%3*65536 + g*256 + b)*0.1e0 - 10000e0')} END AS v FROM image""",
)
def _(c: Collection):
    return c.image.select(*PIXEL, fixed(rules.terrain_rgb(F.col("r") % 3, "g", "b")).alias("v"))


def _byte(v: str) -> str:
    return f"CAST(greatest(0, least(255, floor({v} + 0.5e0))) AS INTEGER)"


@query(
    "ortho_pixels",
    with_sql("image")
    + f"""SELECT raster_id, row, col, {_byte('r*1.3e0 - 20e0')} AS r,
      CASE WHEN raster_id % 3 = 0 THEN {_byte('r*1.3e0 - 20e0')} ELSE {_byte('g*1.3e0 - 20e0')} END AS g,
      CASE WHEN raster_id % 3 = 0 THEN {_byte('r*1.3e0 - 20e0')} ELSE {_byte('b*1.3e0 - 20e0')} END AS b,
      CASE WHEN raster_id % 4 = 0 THEN {_byte('row*5e0')} ELSE 255 END AS a FROM image""",
)
def _(c: Collection):
    bands = F.when(F.col("raster_id") % 3 == 0, 1).otherwise(3)
    alpha = F.when(F.col("raster_id") % 4 == 0, F.col("row") * 5.0)
    stretched = [F.col(k) * 1.3 - 20.0 for k in "rgb"]
    return c.image.select(*PIXEL, *(v.alias(k) for k, v in colour.rgba(*stretched, alpha, bands).items()))


_T3 = "(v - lo)/greatest(hi - lo, 1e-4)"


@query(
    "ramp3",
    with_sql("dsm")
    + "SELECT raster_id, row, col, "
    + ", ".join(f"CASE WHEN v IS NOT NULL THEN {q(ramp(_T3, STOPS3, k))} END AS {n}" for k, n in enumerate("rgb"))
    + " FROM dsm, (SELECT min(v) AS lo, max(v) AS hi FROM dsm)",
)
def _(c: Collection):
    scale = as_scalar(R.shared_ramp(R.dem_range(c.dsm)))
    rgb = colour.ramp3("v", scale["ramp_min"], scale["ramp_max"])
    return c.dsm.withColumn("k", rgb).select(*PIXEL, *fixed_as(r="k.r", g="k.g", b="k.b"))


_UV = ("((k.c + k.a*p.col) - i.c)/i.a", "((k.f + k.e*p.row) - i.f)/i.e")


@query(
    "texel_uv",
    with_sql("dsm", "dsm_catalog", "image_catalog")
    + f"""SELECT p.raster_id, p.row, p.col, {q('(p.col+0.5e0)/25e0')} AS u, {q('(p.row+0.5e0)/25e0')} AS v,
      CASE WHEN p.raster_id % 5 = 0 THEN {q('p.col/24e0')} ELSE {q(f'({_UV[0]} + 0.5e0)/46e0')} END AS iu,
      CASE WHEN p.raster_id % 5 = 0 THEN {q('p.row/24e0')} ELSE {q(f'({_UV[1]} + 0.5e0)/46e0')} END AS iv
      FROM dsm p JOIN dsm_catalog k USING (raster_id) JOIN image_catalog i USING (raster_id)""",
)
def _(c: Collection):
    # One image in five has no georeference and is stretched.
    images = c.image_catalog.select(
        "raster_id",
        F.when(F.col("raster_id") % 5 != 0, frame.geo_struct()).alias("ig"),
        F.col("width").alias("iw"),
        F.col("height").alias("ih"),
    )
    info = c.dsm_catalog.select("raster_id", "width", "height", frame.geo_struct().alias("geo"))
    joined = join_catalog(join_catalog(c.dsm, info, "raster_id", ["row", "col"]), images, "raster_id", ["row", "col"])
    uv = frame.texel_uv("col", "row", "width", "height")
    iuv = frame.image_uv("col", "row", F.col("geo"), "width", "height", F.col("ig"), "iw", "ih")
    return joined.select(*PIXEL, *fixed_as(**uv, **iuv))


# --- rasterising, resampling, composing -------------------------------------


@query("points_to_dsm", with_sql("dsm") + f"SELECT raster_id, row, col, {q('v')} AS v FROM dsm")
def _(c: Collection):
    return c.dsm.select(*PIXEL, *fixed_as(v="v"))


@query("points_to_dtm", with_sql("dtm") + f"SELECT raster_id, row, col, {q('v')} AS v FROM dtm")
def _(c: Collection):
    return c.dtm.select(*PIXEL, *fixed_as(v="v"))


@query("resample_grid", with_sql("dsm_ground") + f"SELECT raster_id, row, col, {q('sample')} AS sample FROM dsm_ground")
def _(c: Collection):
    done = dsm_with_ground(c)
    return done.select(F.col("grid_id").alias("raster_id"), "row", "col", *fixed_as(sample="sample"))


@query(
    "height_above_ground",
    with_sql("dtm_dsm", "dtm_dhm")
    + f"""SELECT raster_id, row, col, 'surface' AS kind, {q('sample - v')} AS height FROM dtm_dsm UNION ALL
      SELECT raster_id, row, col, 'height', {q('sample')} FROM dtm_dhm""",
)
def _(c: Collection):
    both = [
        R.height_above_ground(ground_with_dsm(c), F.lit("surface")).withColumn("kind", F.lit("surface")),
        R.height_above_ground(ground_with_dhm(c), F.lit("height")).withColumn("kind", F.lit("height")),
    ]
    stacked = both[0].unionByName(both[1])
    return stacked.select(F.col("grid_id").alias("raster_id"), "row", "col", "kind", *fixed_as(height="height"))


_SURFACE = "CASE WHEN v IS NULL OR sample IS NULL THEN -9999e0 ELSE sample + greatest({h}, 0e0) END"


@query(
    "compose_above_ground",
    with_sql("dsm_ground", "dhm_ground")
    + f"""SELECT raster_id, row, col, 'surface' AS kind, {q(_SURFACE.format(h='v - sample'))} AS surface,
        {q('sample')} AS ground FROM dsm_ground UNION ALL
      SELECT raster_id, row, col, 'height', {q(_SURFACE.format(h='v'))}, {q('sample')} FROM dhm_ground""",
)
def _(c: Collection):
    parts = [
        R.compose_above_ground(dsm_with_ground(c), F.lit("surface")).withColumn("kind", F.lit("surface")),
        R.compose_above_ground(dhm_with_ground(c), F.lit("height")).withColumn("kind", F.lit("height")),
    ]
    stacked = R.written_surface(parts[0].unionByName(parts[1]))
    return stacked.select(
        F.col("grid_id").alias("raster_id"), "row", "col", "kind", *fixed_as(surface="surface", ground="sample")
    )


@query(
    "composed_pairs",
    with_sql("dtm_on_dhm", "far", extra={
        "far_on": on_raster("dhm", "dhm_catalog", "dtm_catalog").replace("raster_id) JOIN dtm_catalog s USING (raster_id)",
          "raster_id) JOIN (SELECT * REPLACE (CASE WHEN raster_id % 4 = 0 THEN c + 100000e0 ELSE c END AS c) FROM dtm_catalog) s USING (raster_id)"),
        "far": resample("far_on", "dtm"),
    })
    + """SELECT raster_id, count(*) FILTER (v IS NOT NULL AND sample IS NOT NULL) AS known FROM far GROUP BY raster_id""",
)
def _(c: Collection):
    """One terrain in four is moved away, so that its pair fails."""
    away = c.dtm_catalog.withColumn("c", F.expr("CASE WHEN raster_id % 4 = 0 THEN c + 100000D ELSE c END"))
    resampled = R.resample_grid(c.dhm, c.dtm, _same_id(c), c.dhm_catalog, away)
    pairs = R.composed_pairs(R.compose_above_ground(resampled, F.lit("height")))
    return pairs.select(F.col("grid_id").alias("raster_id"), "known")


_COVER = """SELECT t.raster_id, t.row, t.col, greatest(0e0, coalesce(a.sample - a.v, 0e0), coalesce(b.sample, 0e0)) AS cover
  FROM dtm t JOIN dtm_dsm a USING (raster_id, row, col) JOIN dtm_dhm b USING (raster_id, row, col)"""


def cover(c: Collection) -> DataFrame:
    heights = [
        R.height_above_ground(ground_with_dsm(c), F.lit("surface")),
        R.height_above_ground(ground_with_dhm(c), F.lit("height")),
    ]
    return R.tallest_cover(c.dtm, heights)


@query("tallest_cover", with_sql("cover", extra={"cover": _COVER}) + f"SELECT raster_id, row, col, {q('cover')} AS cover FROM cover")
def _(c: Collection):
    return cover(c).select(*PIXEL, *fixed_as(cover="cover"))


@query(
    "covered_mask",
    with_sql("cover", extra={"cover": _COVER}) + "SELECT raster_id, row, col, cover > 0.5e0 AS covered FROM cover",
)
def _(c: Collection):
    return R.covered_mask(cover(c)).select(*PIXEL, "covered")


@query(
    "height_cut",
    with_sql("dhm_ground")
    + f"""SELECT raster_id, row, col, {q('surface')} AS surface FROM (
      SELECT *, sample + greatest(v, 0e0) AS surface FROM dhm_ground WHERE v IS NOT NULL AND sample IS NOT NULL)
      WHERE surface - sample >= 0.5e0""",
)
def _(c: Collection):
    surface = R.compose_above_ground(dhm_with_ground(c), F.lit("height"))
    cut = R.height_cut(surface)
    return cut.select(F.col("grid_id").alias("raster_id"), "row", "col", *fixed_as(surface="surface"))


# --- ground heights ---------------------------------------------------------

_GP = pixel_of("p.x", "p.y", "k")


def _targets(points: str, catalog: str) -> str:
    return f"""SELECT p.*, {_GP[0]} AS px, {_GP[1]} AS py, k.raster_id, k.width, k.height
      FROM {points} p JOIN {catalog} k ON k.raster_id = p.file_id"""


_PTS_TID = "SELECT *, file_idx*1000 + file_id AS tid FROM pts"
_DRAPE = {
    "pts_tid": _PTS_TID,
    "dtm_targets": _targets("pts_tid", "dtm_catalog"),
    "dsm_targets": _targets("pts_tid", "dsm_catalog"),
    "on_dtm": ground("dtm_targets", "dtm_filled"),
    "on_dsm": ground("dsm_targets", "dsm_filled"),
}


def drape(c: Collection, pixels: DataFrame, catalog: DataFrame) -> DataFrame:
    keyed = c.points.select(F.col("file_id").alias("raster_id"), "file_id", "file_idx", "x", "y", "z")
    return R.drape_points(keyed, to_blocks(pixels, ["v", "filled"]), catalog)


@query(
    "drape_points",
    with_sql("on_dsm", extra=_DRAPE) + f"SELECT file_id, file_idx, {q('ground')} AS ground FROM on_dsm",
)
def _(c: Collection):
    return drape(c, c.dsm_filled, c.dsm_catalog).select("file_id", "file_idx", *fixed_as(ground="ground"))


_FIRST = """SELECT a.file_id, a.file_idx, a.z, coalesce(a.ground, b.ground) AS ground
  FROM on_dtm a JOIN on_dsm b USING (file_id, file_idx)"""


def first_ground(c: Collection) -> DataFrame:
    """The coarse terrain first, then the finer surface where it has no data."""
    keyed = c.points.select(F.col("file_id").alias("raster_id"), "file_id", "file_idx", "x", "y", "z")
    rasters = ((c.dtm_filled, c.dtm_catalog), (c.dsm_filled, c.dsm_catalog))
    return R.drape_first(keyed, [(to_blocks(pixels, ["v", "filled"]), catalog) for pixels, catalog in rasters])


@query(
    "first_ground",
    with_sql("first_ground", extra={**_DRAPE, "first_ground": _FIRST})
    + f"SELECT file_id, file_idx, {q('ground')} AS ground FROM first_ground",
)
def _(c: Collection):
    return first_ground(c).select("file_id", "file_idx", *fixed_as(ground="ground"))


@query(
    "path_clearance",
    with_sql("first_ground", extra={**_DRAPE, "first_ground": _FIRST})
    + f"""SELECT file_id, file_idx, {q('''CASE WHEN file_id % 2 = 0 THEN coalesce(ground + 2e0, z)
      ELSE CASE WHEN ground IS NULL THEN z ELSE greatest(z, ground + 1e0) END END''')} AS path_z FROM first_ground""",
)
def _(c: Collection):
    mode = F.when(F.col("file_id") % 2 == 0, "walk").otherwise("fly")
    return R.path_clearance(first_ground(c), mode).select("file_id", "file_idx", *fixed_as(path_z="path_z"))


@query(
    "ground_candidates",
    with_sql("pts", "dtm_box")
    + """SELECT file_id, file_idx, count(*) AS rasters, min(raster_id) AS first_raster FROM (
      SELECT *, CASE WHEN file_idx % 2 = 0 THEN x + 120e0 ELSE x END AS mx FROM pts) p
      JOIN dtm_box b ON mx >= minx AND mx <= maxx AND y >= miny AND y <= maxy GROUP BY ALL""",
)
def _(c: Collection):
    """Rasters whose extent holds a point, when points do not name theirs."""
    moved = F.when(F.col("file_idx") % 2 == 0, F.col("x") + 120.0).otherwise(F.col("x"))
    eyes = c.points.select("file_id", "file_idx", box(moved, F.col("y"), moved, F.col("y")).alias("at"))
    pairs = overlap_join(eyes, c.boxes(c.dtm_catalog, "raster_id", "rb"), "at", "rb", left_points=True)
    return pairs.groupBy("file_id", "file_idx").agg(
        F.count(F.lit(1)).alias("rasters"), F.min("raster_id").alias("first_raster")
    )


# --- aggregates ---------------------------------------------------------------


@query(
    "dem_range",
    with_sql("dsm")
    + f"""SELECT raster_id, {q('coalesce(min(v), 0e0)')} AS zmin, {q('coalesce(max(v), 1e0)')} AS zmax
      FROM dsm GROUP BY raster_id""",
)
def _(c: Collection):
    return R.dem_range(c.dsm).select("raster_id", *fixed_as(zmin="zmin", zmax="zmax"))


@query("shared_ramp", with_sql("dsm") + f"SELECT {q('min(v)')} AS ramp_min, {q('max(v)')} AS ramp_max FROM dsm")
def _(c: Collection):
    return R.shared_ramp(R.dem_range(c.dsm)).select(*fixed_as(ramp_min="ramp_min", ramp_max="ramp_max"))


@query(
    "coverage_fraction",
    with_sql("dsm")
    + f"SELECT raster_id, count(v) AS valid, count(*) AS total, {q('count(v)/count(*)')} AS fraction FROM dsm GROUP BY raster_id",
)
def _(c: Collection):
    return R.coverage_fraction(c.dsm).select("raster_id", "valid", "total", *fixed_as(fraction="fraction"))


_SRC0 = "CAST(floor({t}.i::DOUBLE/11*25) AS INTEGER)"
_SRC1 = "greatest(CAST(floor({t}.i::DOUBLE/11*25) AS INTEGER), least(24, CAST(ceil(({t}.i+1)::DOUBLE/11*25) AS INTEGER) - 1))"


@query(
    "box_downsample",
    with_sql("dsm_filled")
    + f"""SELECT p.raster_id, CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col, {q('avg(filled)')} AS v
      FROM dsm_filled p JOIN range(11) r(i) ON p.row BETWEEN {_SRC0.format(t='r')} AND {_SRC1.format(t='r')}
      JOIN range(11) c(i) ON p.col BETWEEN {_SRC0.format(t='c')} AND {_SRC1.format(t='c')} GROUP BY ALL""",
)
def _(c: Collection):
    """25 x 25 heights to at most 125 pixels: 11 x 11, fractional boxes."""
    filled = c.dsm_filled.select(*PIXEL, F.col("filled").alias("v"))
    return R.box_downsample(filled, c.dsm_catalog, 125).select(*PIXEL, *fixed_as(v="v"))


@query(
    "ortho_downsample",
    with_sql("image")
    + """SELECT raster_id, row // 2 AS row, col // 2 AS col, CAST(floor(avg(r)+0.5e0) AS INTEGER) AS r,
      CAST(floor(avg(g)+0.5e0) AS INTEGER) AS g, CAST(floor(avg(b)+0.5e0) AS INTEGER) AS b,
      CAST(floor(avg(a)+0.5e0) AS INTEGER) AS a FROM image GROUP BY raster_id, row // 2, col // 2""",
)
def _(c: Collection):
    return R.ortho_downsample(c.image, c.image_catalog, 23 * 23)


_DIFF = """SELECT raster_id, col*5 // n AS bx, row*5 // n AS bj,
  CASE WHEN count(v) = count(*) THEN avg(v) END AS mean FROM {src} GROUP BY ALL"""


@query(
    "raster_diff",
    with_sql("ba", "bb", extra={
        "ba": _DIFF.format(src="(SELECT *, 25 AS n FROM dsm)"),
        "bb": _DIFF.format(src="(SELECT *, 10 AS n FROM dtm)"),
    })
    + f"""SELECT a.raster_id AS first_id, {q('coalesce(avg(abs(a.mean - b.mean)), -1e0)')} AS difference,
      count(abs(a.mean - b.mean)) AS blocks FROM ba a JOIN bb b USING (raster_id, bx, bj) GROUP BY a.raster_id""",
)
def _(c: Collection):
    pairs = c.squares.select(F.col("raster_id").alias("first_id"), F.col("raster_id").alias("second_id"))
    diff = R.raster_diff(c.dsm, c.dtm, pairs, c.dsm_catalog, c.dtm_catalog, 5, 5)
    return diff.select("first_id", *fixed_as(difference="difference"), "blocks")


# --- neighbourhoods -------------------------------------------------------------


@query("fill_nearest", with_sql("dsm_filled") + f"SELECT raster_id, row, col, {q('filled')} AS filled FROM dsm_filled")
def _(c: Collection):
    return c.dsm_filled.select(*PIXEL, *fixed_as(filled="filled"))


_SHADE = """
 SELECT raster_id, row, col, greatest(0e0, least(1.3e0, 0.35e0 + 0.65e0*
   greatest((0.5e0*hx + 0.70710678e0 + 0.5e0*hz)/sqrt(hx*hx + hz*hz + 1), 0e0)/0.70710678e0)) AS shade FROM (
  SELECT p.raster_id, p.row, p.col, (e.filled - w.filled)/20e0 AS hx, (s.filled - n.filled)/20e0 AS hz
  FROM dsm_filled p
  JOIN dsm_filled w ON w.raster_id = p.raster_id AND w.row = p.row AND w.col = greatest(p.col-1, 0)
  JOIN dsm_filled e ON e.raster_id = p.raster_id AND e.row = p.row AND e.col = least(p.col+1, 24)
  JOIN dsm_filled n ON n.raster_id = p.raster_id AND n.col = p.col AND n.row = greatest(p.row-1, 0)
  JOIN dsm_filled s ON s.raster_id = p.raster_id AND s.col = p.col AND s.row = least(p.row+1, 24))"""


@query("hillshade", with_sql("shaded", extra={"shaded": _SHADE}) + f"SELECT raster_id, row, col, {q('shade')} AS shade FROM shaded")
def _(c: Collection):
    return R.hillshade(c.dsm_filled, c.dsm_catalog).select(*PIXEL, *fixed_as(shade="shade"))


def _side(dr: int, dc: int) -> str:
    return f"""EXISTS (SELECT 1 FROM dsm s WHERE s.raster_id = p.raster_id AND s.v IS NOT NULL AND
      {'s.row = p.row' if dr == 0 else f's.row BETWEEN p.row + {min(dr, 6 * dr)} AND p.row + {max(dr, 6 * dr)}'} AND
      {'s.col = p.col' if dc == 0 else f's.col BETWEEN p.col + {min(dc, 6 * dc)} AND p.col + {max(dc, 6 * dc)}'})"""


@query(
    "find_voids",
    with_sql("dsm")
    + f"""SELECT raster_id, row, col FROM dsm p WHERE v IS NULL AND row BETWEEN 6 AND 18 AND col BETWEEN 6 AND 18
      AND {_side(-1, 0)} AND {_side(1, 0)} AND {_side(0, -1)} AND {_side(0, 1)}""",
)
def _(c: Collection):
    return R.find_voids(c.dsm, c.dsm_catalog)


_TINT_RAMP = "(t.v - lo)/greatest(hi - lo, 1e-4)"


def _tint(k: int, band: str) -> str:
    base = f"CASE WHEN m.r IS NOT NULL AND c.cover > 0.5e0 THEN 0.3e0 WHEN m.r IS NOT NULL THEN m.{band}/255e0 ELSE {ramp(_TINT_RAMP, STOPS3, k)} END"
    return q(f"({base})*s.shade")


_DTM_SHADE = _SHADE.replace("dsm_filled", "dtm_filled").replace("/20e0", "/50e0").replace(", 24)", ", 9)")
_TINT_EXTRA = {"cover": _COVER, "shaded": _DTM_SHADE}


@query(
    "ground_tint",
    with_sql("shaded", "cover", "image", "dtm", "dtm_catalog", "image_catalog", extra=_TINT_EXTRA)
    + f"""SELECT t.raster_id, t.row, t.col, {_tint(0, 'r')} AS r, {_tint(1, 'g')} AS g, {_tint(2, 'b')} AS b
      FROM dtm t JOIN shaded s USING (raster_id, row, col) JOIN cover c USING (raster_id, row, col)
      JOIN (SELECT min(v) AS lo, max(v) AS hi FROM dtm) ON true
      JOIN dtm_catalog g ON g.raster_id = t.raster_id JOIN image_catalog i ON i.raster_id = t.raster_id
      LEFT JOIN image m ON m.raster_id = t.raster_id AND t.raster_id % 2 = 0
       AND m.col = CAST(round((g.c + g.a*t.col - i.c)/i.a) AS INTEGER) AND m.row = CAST(round((g.f + g.e*t.row - i.f)/i.e) AS INTEGER)
      WHERE t.v IS NOT NULL""",
)
def _(c: Collection):
    """Half of the terrains carry an image, sampled at each of their pixels; the others, and pixels outside it, the ramp.

    Terrain pixels fall on centres of image pixels here, so the twin needs no weights.
    """
    scale = as_scalar(R.shared_ramp(R.dem_range(c.dtm)))
    known = c.dtm.where(F.col("v").isNotNull())
    flown = c.squares.where(F.col("raster_id") % 2 == 0).select(F.col("raster_id").alias("grid_id"), F.col("raster_id").alias("source_id"))
    placed = R.on_raster(known.select(*PIXEL), flown, c.dtm_catalog, c.image_catalog)
    image = sample_image(placed, to_blocks(c.image, ["r", "g", "b"]), outs=("ir", "ig", "ib")).where("NOT outside").select(
        F.col("grid_id").alias("raster_id"), "row", "col", F.struct(*(F.col(f"i{k}").alias(k) for k in "rgb")).alias("image")
    )
    shaded = R.hillshade(c.dtm_filled, c.dtm_catalog)
    joined = (
        known.join(shaded.select(*PIXEL, "shade"), PIXEL)
        .join(cover(c), PIXEL)
        .join(image, PIXEL, "left")
    )
    rgb = colour.ground_tint("cover", F.col("image"), F.col("ramp"), "shade")
    return (
        joined.withColumn("ramp", colour.ramp3("v", scale["ramp_min"], scale["ramp_max"]))
        .withColumn("tint", rgb)
        .select(*PIXEL, *fixed_as(r="tint.r", g="tint.g", b="tint.b"))
    )


# --- warp -----------------------------------------------------------------------

# The rotation of the fixture rasters, in radians, and its cosine and sine.
_COS, _SIN = 0.955336489125606, 0.29552020666133955
_ROTATED = f"""SELECT raster_id, 10e0*{_COS}e0 AS a, 10e0*{_SIN}e0 AS b, c, 10e0*{_SIN}e0 AS d,
  -10e0*{_COS}e0 AS e, f, width, height FROM dsm_catalog"""
_UPRIGHT = """SELECT raster_id, px AS a, 0e0 AS b, minx AS c, 0e0 AS d, -py AS e, maxy AS f,
  CAST(floor((maxx-minx)/px + 1e-9) AS INTEGER) + 1 AS width, CAST(floor((maxy-miny)/py + 1e-9) AS INTEGER) + 1 AS height FROM (
  SELECT raster_id, sqrt(a*a + d*d) AS px, sqrt(b*b + e*e) AS py,
   least(c, c+a*24, c+b*24, c+a*24+b*24) AS minx, greatest(c, c+a*24, c+b*24, c+a*24+b*24) AS maxx,
   least(f, f+d*24, f+e*24, f+d*24+e*24) AS miny, greatest(f, f+d*24, f+e*24, f+d*24+e*24) AS maxy FROM rotated)"""
_WARP_GRID = """SELECT raster_id, CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col, 0 AS v
  FROM upright u, range(64) r(i), range(64) c(i) WHERE r.i < u.height AND c.i < u.width"""


def rotated_catalog(c: Collection) -> DataFrame:
    return c.dsm_catalog.select(
        "raster_id", F.lit(10.0 * _COS).alias("a"), F.lit(10.0 * _SIN).alias("b"), "c",
        F.lit(10.0 * _SIN).alias("d"), F.lit(-10.0 * _COS).alias("e"), "f", "width", "height",
    )


@query(
    "warp_rotated",
    with_sql("warped", extra={
        "rotated": _ROTATED, "upright": _UPRIGHT, "warp_grid": _WARP_GRID,
        "warp_on": on_raster("warp_grid", "upright", "rotated"), "warped": resample("warp_on", "dsm"),
    })
    + f"SELECT raster_id, row, col, {q('sample')} AS v FROM warped",
)
def _(c: Collection):
    catalog = rotated_catalog(c)
    warped = R.warp_raster(c.dsm, catalog, R.north_up_grid(catalog))
    return warped.select(*PIXEL, *fixed_as(v="v"))


# Metres back to degrees: the cone of EPSG:2154 inverted, latitude in six passes.
_K = cone_constants(resolve(2154))


def _degrees_sql(x: str, y: str) -> tuple[str, str]:
    dx, dy = f"({x} - 700000e0)", f"({_K['rho0']!r}::DOUBLE - ({y} - 6600000e0))"
    t = f"pow(sqrt({dx}*{dx} + {dy}*{dy})/{_K['scale']!r}::DOUBLE, {1 / _K['n']!r}::DOUBLE)"
    phi = "pi()/2 - 2*atan(t)"
    for _ in range(6):
        phi = f"pi()/2 - 2*atan(t*exp(-{_K['e']!r}::DOUBLE*atanh({_K['e']!r}::DOUBLE*sin({phi}))))"
    return f"degrees(atan2({dx}, {dy})/{_K['n']!r}::DOUBLE) + 3e0", f"(SELECT degrees({phi}) FROM (SELECT {t} AS t))"


_LON, _LAT = _degrees_sql("u.c + 10e0*p.col", "u.f - 10e0*p.row")
_FX, _FY = _project_sql("c", "f", _CONE, (3, 700000, 6600000))
_WARPED = {
    "degrees": "SELECT raster_id, c/5000e0 + 2e0 AS c, f/5000e0 + 45e0 AS f, width, height FROM dsm_catalog",
    "metres": f"SELECT raster_id, {_FX} AS c, {_FY} AS f FROM degrees",
    "placed": f"""SELECT (u.raster_id*100 + p.row)*100 + p.col AS tid, u.raster_id, p.row, p.col,
       ({_LON} - s.c)/0.0001e0 AS px, ({_LAT} - s.f)/-0.0001e0 AS py, s.width, s.height
      FROM metres u JOIN degrees s USING (raster_id),
       (SELECT CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col FROM range(30) r(i), range(24) c(i)) p""",
    "back": resample("placed", "dsm"),
}


@query(
    "warp_raster",
    with_sql("back", "dsm", extra=_WARPED) + "SELECT raster_id, row, col, CAST(floor(sample*1e2 + 0.5e0) AS BIGINT) AS v_cm FROM back",
)
def _(c: Collection):
    """Rasters in degrees onto a metre grid; the wanted grid is a parameter. In centimetres: the two engines differ in the last bits of a degree."""
    step = 0.0001
    geographic = c.dsm_catalog.select(
        "raster_id", F.lit(step).alias("a"), F.lit(0.0).alias("b"), (F.col("c") / 5000.0 + 2.0).alias("c"),
        F.lit(0.0).alias("d"), F.lit(-step).alias("e"), (F.col("f") / 5000.0 + 45.0).alias("f"), "width", "height",
    )
    target = geographic.withColumn("corner", reproject_batches("c", "f", 4171, 2154)).select(
        "raster_id", F.lit(10.0).alias("a"), F.lit(0.0).alias("b"), F.col("corner.x").alias("c"), F.lit(0.0).alias("d"),
        F.lit(-10.0).alias("e"), F.col("corner.y").alias("f"), F.lit(24).alias("width"), F.lit(30).alias("height"),
    )
    warped = R.warp_raster(c.dsm, geographic, target, 4171, 2154)
    return warped.select(*PIXEL, F.floor(F.col("v") * 1e2 + 0.5).cast("long").alias("v_cm"))


_TURNED = f"""SELECT raster_id, 5e0*{_COS}e0 AS a, 5e0*{_SIN}e0 AS b, c, 5e0*{_SIN}e0 AS d,
  -5e0*{_COS}e0 AS e, f, width, height FROM image_catalog"""
_IMAGE_AT = pixel_of("g.c + g.a*p.col", "g.f + g.e*p.row", "s")
_TURNED_CTE = {
    "turned": _TURNED,
    "level": _UPRIGHT.replace("*24", "*45").replace("FROM rotated", "FROM turned"),
    "seen": f"""SELECT g.raster_id, p.row, p.col, {_IMAGE_AT[0]} AS px, {_IMAGE_AT[1]} AS py, s.width, s.height
      FROM level g JOIN turned s USING (raster_id),
       (SELECT CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col FROM range(80) r(i), range(80) c(i)) p
      WHERE p.row < g.height AND p.col < g.width""",
    # a hole without cover inside each image
    "holed": "SELECT raster_id, row, col, r, g, b, CASE WHEN row BETWEEN 10 AND 14 AND col BETWEEN 20 AND 29 THEN 0 ELSE 255 - col END AS a FROM image",
    "near": f"""SELECT t.raster_id, t.row, t.col, sum(w*m.a) AS cover, sum(w*m.a*m.r) AS r, sum(w*m.a*m.g) AS g, sum(w*m.a*m.b) AS b
      FROM (SELECT *, floor(py) + dr AS sr, floor(px) + dc AS sc, CASE WHEN dr = 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END
         * CASE WHEN dc = 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END AS w FROM seen, {NEIGHBOURS}
       WHERE px >= -0.5e0 AND px <= width - 0.5e0 AND py >= -0.5e0 AND py <= height - 0.5e0) t
      JOIN holed m ON m.raster_id = t.raster_id AND m.row = t.sr AND m.col = t.sc GROUP BY ALL""",
}


def _byte(band: str) -> str:
    return f"CAST(CASE WHEN n.cover > 0 THEN floor(n.{band}/n.cover + 0.5e0) ELSE 0 END AS INTEGER) AS {band}"


@query(
    "warp_image",
    with_sql("near", "level", extra=_TURNED_CTE)
    + f"""SELECT s.raster_id, s.row, s.col, {_byte('r')}, {_byte('g')}, {_byte('b')},
      CAST(floor(coalesce(n.cover, 0e0) + 0.5e0) AS INTEGER) AS a FROM seen s LEFT JOIN near n USING (raster_id, row, col)""",
)
def _(c: Collection):
    """Rotated images north-up: no cover outside, colours of transparent pixels do not bleed in."""
    hole = F.col("row").between(10, 14) & F.col("col").between(20, 29)
    image = c.image.withColumn("a", F.when(hole, 0).otherwise(255 - F.col("col")))
    catalog = c.image_catalog.withColumns(
        {"a": F.lit(5.0 * _COS), "b": F.lit(5.0 * _SIN), "d": F.lit(5.0 * _SIN), "e": F.lit(-5.0 * _COS)}
    )
    return R.warp_image(image, catalog, R.north_up_grid(catalog))

