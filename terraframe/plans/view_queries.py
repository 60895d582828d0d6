"""Queries on viewpoints: reach, resolution, refinement, frustum, screen thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions import frame, rules
from terraframe.functions.colour import ramp5
from terraframe.operators import lod as L
from terraframe.operators import points as P
from terraframe.operators.blocks import to_blocks
from terraframe.operators.lookup import join_catalog
from terraframe.plans.collection import Collection
from terraframe.plans.point_queries import _HASH, _LOD_CTE, _SCENE_PTS, DEPTHS, SPACING
from terraframe.plans.registry import fixed_as, query
from terraframe.plans.sql import STOPS5, fixed as q, ramp as ramp_sql, scene_of, with_sql
from terraframe.sources.tables import read_plan

FOV, HEIGHT = 55.0, 180.0
TILE = ["file_id", "gx", "gy"]

# Principal box of the 4 x 4 tiles in scene coordinates. SQL needs no axes:
# the projection matrix of an eigenvalue is a product of (C - other eigenvalue).
_TILES4 = """
 SELECT e.file_id, e.gx, e.gy, n AS point_count, e.wx*e.wy AS tile_area, sqrt(greatest(0e0, l1)) AS e1,
  sqrt(greatest(0e0, l2)) AS e2, sqrt(greatest(0e0, l3)) AS e3, l1, l2, l3, c00, c01, c02, c11, c12, c22,
  e.lox, e.hix, e.loz, e.hiz, e.minz AS loy, e.maxz AS hiy FROM (
  SELECT m.*, (b.maxx-b.minx)/4e0 AS wx, (b.maxy-b.miny)/4e0 AS wy,
   (b.minx + m.gx*((b.maxx-b.minx)/4e0) - fr.cx)/fr.scale AS lox,
   (CASE WHEN m.gx = 3 THEN b.maxx ELSE b.minx + m.gx*((b.maxx-b.minx)/4e0) + (b.maxx-b.minx)/4e0 END - fr.cx)/fr.scale AS hix,
   -((CASE WHEN m.gy = 3 THEN b.maxy ELSE b.miny + m.gy*((b.maxy-b.miny)/4e0) + (b.maxy-b.miny)/4e0 END) - fr.cy)/fr.scale AS loz,
   -((b.miny + m.gy*((b.maxy-b.miny)/4e0)) - fr.cy)/fr.scale AS hiz
  FROM scene_eigen m JOIN bounds b USING (file_id), frame fr) e"""
_K = f"({HEIGHT}e0/(2*tan(radians({FOV}e0)*0.5e0)))"
_PAIRS = f"""
 SELECT * FROM (SELECT v.view_id, v.ex, v.ey, v.ez, t.*,
   sqrt(pow((lox+hix)*0.5e0 - ex, 2) + pow((loy+hiy)*0.5e0 - ey, 2) + pow((loz+hiz)*0.5e0 - ez, 2)) AS dist,
   sqrt((e2*e3*4 + e1*e3*4 + e1*e2*4)/25e0)*{_K} AS reach
  FROM views v, tiles4 t) WHERE dist <= reach"""


def _along(l: str, m: str, n: str) -> str:
    """|axis of l . sight|: sqrt(s' (C - m)(C - n) s / ((l - m)(l - n)))."""
    rows_m = (
        f"((c00-{m})*sx + c01*sy + c02*sz)",
        f"(c01*sx + (c11-{m})*sy + c12*sz)",
        f"(c02*sx + c12*sy + (c22-{m})*sz)",
    )
    rows_n = (
        f"((c00-{n})*sx + c01*sy + c02*sz)",
        f"(c01*sx + (c11-{n})*sy + c12*sz)",
        f"(c02*sx + c12*sy + (c22-{n})*sz)",
    )
    dot = " + ".join(f"{a}*{b}" for a, b in zip(rows_m, rows_n))
    return f"sqrt(greatest(0e0, ({dot})/(({l}-{m})*({l}-{n}))))"


_WANTED = f"""
 SELECT *, CASE WHEN area_px < 25e0 OR res > 50e0 THEN 0e0 ELSE greatest(res, 0.1e0) END AS desired,
  greatest(1e0, least(50e0, sqrt(tile_area/500e0))) AS loaded FROM (
  SELECT *, sqrt(tile_area/greatest(100e0, least(500000e0, area_px/25e0))) AS res FROM (
   SELECT *, (e2*e3*4*{_along('l1', 'l2', 'l3')} + e1*e3*4*{_along('l2', 'l1', 'l3')}
     + e1*e2*4*{_along('l3', 'l1', 'l2')})*pow({_K}/greatest(dist, 1e-6), 2) AS area_px FROM (
    SELECT *, ((lox+hix)*0.5e0 - ex)/dist AS sx, ((loy+hiy)*0.5e0 - ey)/dist AS sy,
     ((loz+hiz)*0.5e0 - ez)/dist AS sz FROM pairs)))"""
_CTE = {"tiles4": _TILES4, "pairs": _PAIRS, "wanted": _WANTED}


def wanted(c: Collection) -> DataFrame:
    pairs = L.views_tiles(c.views, L.with_coarse_resolution(c.scene_tiles), FOV, HEIGHT)
    return L.desired_resolution(pairs, FOV, HEIGHT)


@query(
    "view_position",
    with_sql("views") + f"SELECT view_id, {q('ex')} AS ex, {q('ey')} AS ey, {q('ez')} AS ez FROM views",
)
def _(c: Collection):
    return c.views.select("view_id", *fixed_as(ex="ex", ey="ey", ez="ez"))


@query(
    "views_tiles",
    with_sql("pairs", extra=_CTE)
    + f"SELECT view_id, file_id, gx, gy, {q('dist')} AS distance FROM pairs",
)
def _(c: Collection):
    pairs = L.views_tiles(c.views, c.scene_tiles, FOV, HEIGHT)
    return pairs.select("view_id", *TILE, *fixed_as(distance="distance"))


# The projected area goes through two eigenvector formulas that agree to
# about eight digits on well separated extents; millimetres are compared.
_MM = "CAST(floor(desired*1e3 + 0.5e0) AS BIGINT)"


@query(
    "desired_resolution",
    with_sql("wanted", extra=_CTE)
    + f"SELECT view_id, file_id, gx, gy, {_MM} AS desired_mm FROM wanted",
)
def _(c: Collection):
    done = wanted(c)
    return done.select("view_id", *TILE, F.floor(F.col("desired") * 1e3 + 0.5).alias("desired_mm"))


_PLAN = "desired > 0 AND loaded > desired*1.5e0"


@query(
    "refine_plan",
    with_sql("wanted", extra=_CTE) + f"SELECT view_id, file_id, gx, gy FROM wanted WHERE {_PLAN}",
)
def _(c: Collection):
    return L.refine_plan(wanted(c)).select("view_id", *TILE)


@query(
    "refine_topk",
    with_sql("wanted", extra=_CTE)
    + f"""SELECT view_id, file_id, gx, gy, CAST(rk AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY file_id, gy, gx) AS rk FROM wanted WHERE {_PLAN})
      WHERE rk <= 2""",
)
def _(c: Collection):
    plan = L.refine_plan(wanted(c))
    return L.refine_topk(plan, 2).select("view_id", *TILE, "rank")


@query(
    "coarse_resolution",
    with_sql("bounds")
    + f"""SELECT file_id, {q('greatest(1e0, least(50e0, sqrt((maxx-minx)/8e0*((maxy-miny)/8e0)/500e0)))')} AS tiles8,
      {q('greatest(1e0, least(50e0, sqrt((maxx-minx)*(maxy-miny)/500e0)))')} AS whole FROM bounds""",
)
def _(c: Collection):
    dx, dy = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return c.bounds.select(
        "file_id",
        *fixed_as(tiles8=rules.coarse_resolution(dx / 8.0 * (dy / 8.0)), whole=rules.coarse_resolution(dx * dy)),
    )


def _corner(x: str, y: str, z: str) -> tuple[str, str, str]:
    dx, dy, dz = f"({x} - ex)", f"({y} - ey)", f"({z} - ez)"
    right = f"(cos(yaw)*{dx} - sin(yaw)*{dz})"
    up = f"(-sin(pitch)*sin(yaw)*{dx} + cos(pitch)*{dy} - sin(pitch)*cos(yaw)*{dz})"
    ahead = f"(-cos(pitch)*sin(yaw)*{dx} - sin(pitch)*{dy} - cos(pitch)*cos(yaw)*{dz})"
    return right, up, ahead


_CORNERS = [_corner(x, y, z) for x in ("lox", "hix") for y in ("loy", "hiy") for z in ("loz", "hiz")]
_TY = f"tan(radians({FOV}e0)*0.5e0)"
_TX = f"({_TY}*1.6e0)"
_PLANES = " AND ".join(
    "greatest(" + ", ".join(form.format(r=r, u=u, f=f) for r, u, f in _CORNERS) + ") >= 0"
    for form in (
        "{r} + {f}*" + _TX, "-{r} + {f}*" + _TX, "{u} + {f}*" + _TY, "-{u} + {f}*" + _TY,
        "{f} - 1e0/scale", "300e0/scale - {f}",
    )
)


@query(
    "view_frustum",
    with_sql("views", "tiles4", extra=_CTE)
    + f"SELECT view_id, file_id, gx, gy FROM views, tiles4, frame WHERE {_PLANES}",
)
def _(c: Collection):
    # Distances are in scene units; scale the scene instead of the planes so
    # that near and far stay plain numbers (1 m and 300 m).
    sides = ("lox", "loy", "loz", "hix", "hiy", "hiz")
    scaled = ", ".join(f"box.{k} * frame.scale AS {k}" for k in sides)
    metres = c.in_scene(c.scene_tiles).selectExpr(*TILE, f"struct({scaled}) AS box")
    views = c.in_scene(c.views).selectExpr(
        "view_id", "yaw", "pitch", *(f"{k} * frame.scale AS {k}" for k in ("ex", "ey", "ez"))
    )
    return L.view_frustum(views, metres, FOV, 1.6, 1.0, 300.0).select("view_id", *TILE)


_DENSE = """SELECT file_id, CASE WHEN area > 1e-12 THEN n/area ELSE 1e0 END AS density FROM (
  SELECT file_id, count(*) AS n, (max(gx)-min(gx))*(max(gz)-min(gz)) AS area FROM scene_pts GROUP BY file_id)"""
_DEPTH = """greatest(0.001e0, -cos(pitch)*sin(yaw)*(p.gx-ex) - sin(pitch)*(p.gy-ey) - cos(pitch)*cos(yaw)*(p.gz-ez))"""
_STEP = f"({_DEPTH}*100e0*tan(radians({FOV}e0)*0.5e0)/{HEIGHT}e0)"


@query(
    "screen_thin",
    with_sql("hashed", "dense", "views", extra={"scene_pts": _SCENE_PTS, "hashed": _HASH, "dense": _DENSE})
    + f"""SELECT p.file_id, p.file_idx FROM scene_pts p JOIN hashed h USING (file_id, file_idx)
      JOIN dense d USING (file_id) JOIN views v ON v.view_id = p.file_id
      WHERE h.h <= 1e0/greatest(d.density*{_STEP}*{_STEP}, 1e0)""",
)
def _(c: Collection):
    placed = c.scene_points.select("file_id", "file_idx", "gx", "gy", "gz")
    density = P.cloud_density(placed, "gx", "gz").select("file_id", "density")
    views = c.views.select(F.col("view_id").alias("file_id"), "ex", "ey", "ez", "yaw", "pitch")
    return L.screen_thin(join_catalog(placed, density, "file_id", ["file_idx"]), views, FOV, HEIGHT, 50.0).select("file_id", "file_idx")


_S = scene_of("p.x", "p.y", "p.z")
_TILE_QUERY = f"""
 SELECT p.file_id, p.file_idx, CAST(p.depth AS INTEGER) AS depth, {q(_S[0])} AS gx, {q(_S[1])} AS gy, {q(_S[2])} AS gz,
  {', '.join(f"{q(ramp_sql('(p.z - fr.zmin)/greatest(fr.zmax - fr.zmin, 1e-6)', STOPS5, k))} AS {n}" for k, n in enumerate('rgb'))},
  {q('o.ored')} AS ored, {q('o.ogreen')} AS ogreen, {q('o.oblue')} AS oblue
 FROM lod p JOIN tiled t USING (file_id, file_idx) JOIN coloured o USING (file_id, file_idx), frame fr
 WHERE p.depth <= 2 AND t.gx = p.file_id % 8 AND t.gy = p.file_id % 5"""


@query("tile_query", with_sql("lod", "tiled", "coloured", "frame", extra=_LOD_CTE) + _TILE_QUERY)
def _(c: Collection):
    """One tile of each cloud at 10 m, read from the stored levels: its coarse points, placed and coloured both ways."""
    upto = rules.depth_at_resolution(F.lit(SPACING), F.lit(DEPTHS), F.lit(10.0))
    plan = c.bounds.select(
        "file_id", (F.col("file_id") % 8).cast("int").alias("gx"), (F.col("file_id") % 5).cast("int").alias("gy"), upto.alias("upto")
    )
    found = read_plan(c.spark, c.lod_table(SPACING, DEPTHS), plan)
    scene = frame.to_scene("x", "y", "z", F.col("frame"))
    coloured = P.colorize_points(c.image_positions(found), to_blocks(c.image, ["r", "g", "b"]))
    ramp = ramp5("z", "frame.zmin", "frame.zmax", 1e-6)
    done = c.in_scene(coloured).withColumn("k", ramp)
    return done.select(
        "file_id", "file_idx", "depth",
        *fixed_as(**scene, r="k.r", g="k.g", b="k.b", ored="ored", ogreen="ogreen", oblue="oblue"),
    )
