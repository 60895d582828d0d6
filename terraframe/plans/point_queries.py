"""Queries on points: projections, filters, thinning, tiles, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraframe.functions import colour, frame, rules
from terraframe.functions.crs import cone_constants, reproject, resolve
from terraframe.operators import points as P
from terraframe.operators.blocks import to_blocks
from terraframe.operators.lookup import join_catalog
from terraframe.plans.collection import Collection
from terraframe.plans.registry import fixed_as, query
from terraframe.plans.sql import STOPS5, fixed as q, ramp, scene_of, with_sql

KEY = ["file_id", "file_idx"]
THIN = 300
SPACING, DEPTHS = 40.0, 4


@query(
    "scale_offset",
    with_sql("pts")
    + f"""SELECT file_id, file_idx, {q('floor(x*100+0.5e0)*0.01e0 + 1000e0')} AS x,
      {q('floor(y*100+0.5e0)*0.01e0 + 2000e0')} AS y, {q('floor(z*100+0.5e0)*0.01e0 + 0e0')} AS z FROM pts""",
)
def _(c: Collection):
    raw = {k: F.floor(F.col(k) * 100 + 0.5) for k in "xyz"}
    world = {k: frame.scale_offset(raw[k], 0.01, o) for k, o in zip("xyz", (1000.0, 2000.0, 0.0))}
    return c.points.select(*KEY, *fixed_as(**world))


@query(
    "rgb_norm",
    with_sql("pts")
    + f"""SELECT file_id, file_idx, {q('red/65535e0')} AS r, {q('green/65535e0')} AS g,
      {q('blue/65535e0')} AS b FROM pts""",
)
def _(c: Collection):
    rgb = colour.rgb_norm("red", "green", "blue")
    return c.points.select(*KEY, *fixed_as(r=rgb["r"], g=rgb["g"], b=rgb["b"]))


_S = scene_of("p.x", "p.y", "p.z")


@query(
    "to_scene",
    with_sql("pts", "frame")
    + f"""SELECT file_id, file_idx, {q(_S[0])} AS gx, {q(_S[1])} AS gy, {q(_S[2])} AS gz
      FROM pts p, frame fr""",
)
def _(c: Collection):
    return c.scene_points.select(*KEY, *fixed_as(gx="gx", gy="gy", gz="gz"))


@query(
    "to_world",
    with_sql("pts", "frame")
    + f"""SELECT file_id, file_idx, {q(f'cx + ({_S[0]})*scale')} AS x,
      {q(f'cy - ({_S[2]})*scale')} AS y, {q(f'cz + ({_S[1]})*scale')} AS z FROM pts p, frame fr""",
)
def _(c: Collection):
    placed = c.in_scene(c.scene_points)
    return placed.select(*KEY, *fixed_as(**frame.to_world("gx", "gy", "gz", F.col("frame"))))


@query(
    "ramp5",
    with_sql("pts", "frame")
    + "SELECT file_id, file_idx, "
    + ", ".join(
        f"{q(ramp('(z - zmin)/greatest(zmax - zmin, 1e-9)', STOPS5, k))} AS {n}" for k, n in enumerate("rgb")
    )
    + " FROM pts, frame",
)
def _(c: Collection):
    rgb = colour.ramp5("z", "frame.zmin", "frame.zmax")
    return c.in_scene(c.points).withColumn("c", rgb).select(*KEY, *fixed_as(r="c.r", g="c.g", b="c.b"))


def _own_or_ramp(channel: str, k: int) -> str:
    by_height = ramp('(z - zmin)/greatest(zmax - zmin, 1e-9)', STOPS5, k)
    return q(f"CASE WHEN file_id % 2 = 0 THEN {channel}/65535e0 ELSE {by_height} END")


@query(
    "point_colour",
    with_sql("pts", "frame")
    + "SELECT file_id, file_idx, "
    + ", ".join(f"{_own_or_ramp(c, k)} AS {c[0]}" for k, c in enumerate(("red", "green", "blue")))
    + " FROM pts, frame",
)
def _(c: Collection):
    # Every second cloud is of a point format without colours.
    own = {k: F.when(F.col("file_id") % 2 == 0, F.col(k)) for k in ("red", "green", "blue")}
    points = c.in_scene(c.points.withColumns(own))
    rgb = colour.point_colour("red", "green", "blue", colour.ramp5("z", "frame.zmin", "frame.zmax"))
    return points.withColumn("c", rgb).select(*KEY, *fixed_as(r="c.r", g="c.g", b="c.b"))


_HASH = """
 SELECT file_id, file_idx, (qx + qy)*qz - floor((qx + qy)*qz) AS h FROM (
  SELECT file_id, file_idx, ax + d AS qx, ay + d AS qy, az + d AS qz FROM (
   SELECT *, ax*(az + 31.32e0) + ay*(ay + 31.32e0) + az*(ax + 31.32e0) AS d FROM (
    SELECT file_id, file_idx, gx*1000e0*0.1031e0 - floor(gx*1000e0*0.1031e0) AS ax,
     gy*1000e0*0.1031e0 - floor(gy*1000e0*0.1031e0) AS ay,
     gz*1000e0*0.1031e0 - floor(gz*1000e0*0.1031e0) AS az FROM scene_pts)))"""
_SCENE_PTS = (
    f"SELECT file_id, file_idx, {_S[0]} AS gx, {_S[1]} AS gy, {_S[2]} AS gz FROM pts p, frame fr"
)


@query(
    "fine_hash",
    with_sql("hashed", extra={"scene_pts": _SCENE_PTS, "hashed": _HASH})
    + f"SELECT file_id, file_idx, {q('h')} AS h FROM hashed",
)
def _(c: Collection):
    return c.scene_points.select(*KEY, *fixed_as(h=frame.fine_hash("gx", "gy", "gz")))


_CONE = cone_constants(resolve(2154))
_LON, _LAT = "(2e0 + x/5000e0)", "(45e0 + y/5000e0)"


def _project_sql(lon: str, lat: str, cone: dict, origin: tuple) -> tuple[str, str]:
    e, n = repr(cone["e"]) + "::DOUBLE", repr(cone["n"]) + "::DOUBLE"
    t = f"(tan(pi()/4 - radians({lat})/2)*pow((1+{e}*sin(radians({lat})))/(1-{e}*sin(radians({lat}))), {e}/2))"
    rho = f"({cone['scale']!r}::DOUBLE*pow({t}, {n}))"
    theta = f"({n}*radians({lon} - {origin[0]}e0))"
    return (
        f"({origin[1]}e0 + {rho}*sin({theta}))",
        f"({origin[2]}e0 + {cone['rho0']!r}::DOUBLE - {rho}*cos({theta}))",
    )


_PX, _PY = _project_sql(_LON, _LAT, _CONE, (3, 700000, 6600000))


@query(
    "reproject_points",
    with_sql("pts")
    + f"""SELECT file_id, file_idx, CAST(floor({_PX}*1e3 + 0.5e0) AS BIGINT) AS east_mm,
      CAST(floor({_PY}*1e3 + 0.5e0) AS BIGINT) AS north_mm,
      CAST(floor({_LON}*1e8 + 0.5e0) AS BIGINT) AS lon8, CAST(floor({_LAT}*1e8 + 0.5e0) AS BIGINT) AS lat8
      FROM pts""",
)
def _(c: Collection):
    lon, lat = F.lit(2.0) + F.col("x") / 5000.0, F.lit(45.0) + F.col("y") / 5000.0
    x, y = reproject(lon, lat, 4171, 2154)
    placed = c.points.select(*KEY, x.alias("e"), y.alias("n"))
    back_lon, back_lat = reproject("e", "n", 2154, 4171)
    return placed.select(
        *KEY,
        F.floor(F.col("e") * 1e3 + 0.5).alias("east_mm"),
        F.floor(F.col("n") * 1e3 + 0.5).alias("north_mm"),
        F.floor(back_lon * 1e8 + 0.5).alias("lon8"),
        F.floor(back_lat * 1e8 + 0.5).alias("lat8"),
    )


# --- clouds ---------------------------------------------------------------


@query(
    "cloud_bounds",
    with_sql("bounds")
    + "SELECT file_id, point_count, "
    + ", ".join(f"{q(f'{m}{k}')} AS {m}{k}" for m in ("min", "max") for k in "xyz")
    + " FROM bounds",
)
def _(c: Collection):
    names = [m + k for m in ("min", "max") for k in "xyz"]
    return c.bounds.select("file_id", "point_count", *fixed_as(**{n: n for n in names}))


@query(
    "cloud_density",
    with_sql("bounds")
    + f"""SELECT file_id, point_count, {q('''CASE WHEN (maxx-minx)*(maxy-miny) > 1e-12
      THEN point_count/((maxx-minx)*(maxy-miny)) ELSE 1 END''')} AS density FROM bounds""",
)
def _(c: Collection):
    return P.cloud_density(c.points).select("file_id", "point_count", *fixed_as(density="density"))


_GRID = f"""
 SELECT file_id, minx, miny, thin, nx, ny, greatest((maxx-minx)/nx, (maxy-miny)/ny, 1e-9) AS cell FROM (
  SELECT *, greatest(1, CAST(floor((maxx-minx)/c0) AS BIGINT) + 1) AS nx,
   greatest(1, CAST(floor((maxy-miny)/c0) AS BIGINT) + 1) AS ny FROM (
   SELECT *, point_count > {THIN} AS thin,
    greatest(sqrt(greatest((maxx-minx)*(maxy-miny), 1e-12)/{THIN}e0), 1e-9) AS c0 FROM bounds))"""
_KEPT = """
 SELECT file_id, min(file_idx) AS file_idx FROM (
  SELECT p.file_id, file_idx, CASE WHEN thin THEN greatest(0, least(nx-1, floor((x-g.minx)/cell)))
    ELSE file_idx END AS cx,
   CASE WHEN thin THEN greatest(0, least(ny-1, floor((y-g.miny)/cell))) ELSE -1 END AS cy
  FROM pts p JOIN grid g USING (file_id)) GROUP BY file_id, cx, cy"""
_THINNED = with_sql("kept", extra={"grid": _GRID, "kept": _KEPT})
_PT = ", ".join(f"{q(k)} AS {k}" for k in "xyz")


@query(
    "grid_thin",
    _THINNED
    + f"SELECT p.file_id, p.file_idx, {_PT}, red, green, blue FROM pts p JOIN kept USING (file_id, file_idx)",
)
def _(c: Collection):
    kept = P.grid_thin(c.points, c.bounds, THIN)
    return kept.select(*KEY, *fixed_as(x="x", y="y", z="z"), "red", "green", "blue")


@query(
    "file_order",
    _THINNED + f"SELECT p.file_id, p.file_idx, {q('z')} AS z FROM pts p JOIN kept USING (file_id, file_idx) ORDER BY 1, 2",
)
def _(c: Collection):
    return P.file_order(P.grid_thin(c.points, c.bounds, THIN).select(*KEY, *fixed_as(z="z")))


_HEADS = f"""
 SELECT file_id, file_idx, min(d) AS depth FROM (
  SELECT p.file_id, d.d, floor((x-minx)/{SPACING}e0*pow(2e0, d.d)) AS cx,
   floor((y-miny)/{SPACING}e0*pow(2e0, d.d)) AS cy, min(file_idx) AS file_idx
  FROM pts p JOIN bounds b USING (file_id), range({DEPTHS}) d(d) GROUP BY ALL) GROUP BY file_id, file_idx"""
_LOD = f"SELECT p.*, coalesce(h.depth, {DEPTHS}) AS depth FROM pts p LEFT JOIN heads h USING (file_id, file_idx)"
_LOD_CTE = {"heads": _HEADS, "lod": _LOD}


@query(
    "lod_points",
    with_sql("lod", extra=_LOD_CTE)
    + "SELECT file_id, file_idx, CAST(depth AS INTEGER) AS depth FROM lod",
)
def _(c: Collection):
    return P.assign_depth(c.points, c.bounds, SPACING, DEPTHS).select(*KEY, "depth")


@query(
    "depth_at_resolution",
    with_sql("lod", extra=_LOD_CTE)
    + f"""SELECT p.file_id, count(*) AS points, CAST(max(depth) AS INTEGER) AS deepest,
      CAST(sum(file_idx % 1000003) AS BIGINT) AS idx_sum
      FROM lod p WHERE depth <= CASE WHEN p.file_id % 7 = 0 THEN {DEPTHS}
        ELSE least({DEPTHS}, greatest(0, ceil(log2({SPACING}e0/((p.file_id % 7)*5e0))))) END
      GROUP BY p.file_id""",
)
def _(c: Collection):
    # Every cloud asks for its own resolution: 0 (all), 5, 10, .. 30 metres.
    resolution = (F.col("file_id") % 7) * 5.0
    wanted = rules.depth_at_resolution(F.lit(SPACING), F.lit(DEPTHS), resolution)
    kept = P.assign_depth(c.points, c.bounds, SPACING, DEPTHS).where(F.col("depth") <= wanted)
    return kept.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.max("depth").alias("deepest"),
        F.sum(F.col("file_idx") % 1000003).alias("idx_sum"),
    )


# --- tiles ----------------------------------------------------------------


@query(
    "points_to_tiles",
    with_sql("tiled") + "SELECT file_id, file_idx, gx, gy FROM tiled",
)
def _(c: Collection):
    return c.tiled.select(*KEY, "gx", "gy")


@query(
    "tile_filter",
    with_sql("pts", "bounds")
    + """SELECT p.file_id, p.file_idx FROM pts p JOIN bounds b USING (file_id)
      WHERE x >= minx + (file_id % 8)*((maxx-minx)/8e0) AND y >= miny + (file_id % 5)*((maxy-miny)/8e0)
        AND (x < minx + (file_id % 8)*((maxx-minx)/8e0) + (maxx-minx)/8e0 OR (file_id % 8 = 7 AND x <= maxx))
        AND y < miny + (file_id % 5)*((maxy-miny)/8e0) + (maxy-miny)/8e0""",
)
def _(c: Collection):
    # One tile of each cloud, a different one from cloud to cloud.
    boxes = P.tile_boxes(c.bounds).where(
        (F.col("gx") == F.col("file_id") % 8) & (F.col("gy") == F.col("file_id") % 5)
    )
    wanted = boxes.select("file_id", "tile", "cloud_maxx", "cloud_maxy")
    hit = rules.in_tile("x", "y", F.col("tile"), "cloud_maxx", "cloud_maxy")
    return join_catalog(c.points, wanted, "file_id", ["file_idx"]).where(hit).select(*KEY)


@query(
    "tile_stats",
    with_sql("tiled")
    + f"""SELECT file_id, gx, gy, count(*) AS point_count, {q('min(z)')} AS minz, {q('max(z)')} AS maxz
      FROM tiled GROUP BY file_id, gx, gy""",
)
def _(c: Collection):
    stats = P.tile_stats(c.tiled)
    return stats.select(*P.TILE_KEYS, "point_count", *fixed_as(minz="minz", maxz="maxz"))


def _extent_sql(k: int) -> str:
    return q(f"sqrt(greatest(0e0, l{k}))")


@query(
    "tile_pca",
    with_sql("pca_eigen")
    + f"""SELECT file_id, gx, gy, n AS point_count, {_extent_sql(1)} AS e1,
      CAST(floor(greatest(0e0, l2)*1e3 + 0.5e0) AS BIGINT) AS e2_squared,
      CAST(floor(greatest(0e0, l3)*1e3 + 0.5e0) AS BIGINT) AS e3_squared
      FROM pca_eigen""",
)
def _(c: Collection):
    # Three points span a plane, two a line: the squares beyond are zero in
    # both engines up to rounding, their roots are noise.
    pca = P.tile_pca(c.tiled)
    squares = [F.floor(F.col(e) * F.col(e) * 1e3 + 0.5).alias(f"{e}_squared") for e in ("e2", "e3")]
    return pca.select(*P.TILE_KEYS, "point_count", *fixed_as(e1="e1"), *squares)


@query("tile_axes")
def _(c: Collection):
    """Axes of each tile; no SQL twin: a sign and, for equal extents, a choice are free."""
    pca = P.tile_pca(c.tiled)
    axes = {f"a{k}{n}": F.get(f"a{k}", F.lit(i)) for k in (1, 2, 3) for i, n in enumerate("xyz")}
    return pca.select(*P.TILE_KEYS, *(v.alias(k) for k, v in axes.items()))


@query(
    "point_spacing",
    with_sql("pca_eigen")
    + f"""SELECT file_id, gx, gy, n AS point_count,
      CAST(floor(s*1e4 + 0.5e0) AS BIGINT) * CAST(l2 > 1e-2 AS BIGINT) AS spacing, CAST(floor(pow(s, 4)*1e1 + 0.5e0) AS BIGINT) AS fourth_power
      FROM (SELECT *, sqrt(greatest(12e0*sqrt(greatest(0e0,l1))*sqrt(greatest(0e0,l2)), 1e-12)/n) AS s FROM pca_eigen)""",
)
def _(c: Collection):
    # Points on a line have no width but rounding noise: the spacing is given
    # for tiles with a width, its fourth power (the noise itself) for all.
    pca = P.tile_pca(c.tiled)
    s = P.point_spacing(F.col("e1"), F.col("e2"), F.col("point_count"))
    return pca.select(*P.TILE_KEYS, "point_count", F.when(F.col("e2") * F.col("e2") > 1e-2, F.floor(s * 1e4 + 0.5)).otherwise(0).alias("spacing"),
        F.floor(F.pow(s, F.lit(4.0)) * 1e1 + 0.5).alias("fourth_power"),
    )


@query(
    "tile_partition_check",
    with_sql("tiled")
    + """SELECT file_id, file_idx, CAST(sum(g) AS BIGINT) AS given, CAST(sum(t) AS BIGINT) AS tiled FROM (
      SELECT file_id, file_idx, 1 AS g, 0 AS t FROM pts UNION ALL
      SELECT file_id, file_idx, 0, 1 FROM tiled) GROUP BY 1, 2 HAVING sum(g) <> sum(t)""",
)
def _(c: Collection):
    return P.tile_partition_check(c.points, c.tiled)


# --- image colours --------------------------------------------------------


@query(
    "colorize_points",
    with_sql("coloured")
    + f"SELECT file_id, file_idx, {q('ored')} AS ored, {q('ogreen')} AS ogreen, {q('oblue')} AS oblue, outside FROM coloured",
)
def _(c: Collection):
    blocks = to_blocks(c.image, ["r", "g", "b"])
    done = P.colorize_points(c.image_positions(c.points), blocks)
    return done.select(*KEY, *fixed_as(ored="ored", ogreen="ogreen", oblue="oblue"), "outside")


@query(
    "outside_count",
    with_sql("coloured")
    + """SELECT file_id, count(*) FILTER (outside) AS outside_points, count(*) AS point_count
      FROM coloured GROUP BY file_id""",
)
def _(c: Collection):
    blocks = to_blocks(c.image, ["r", "g", "b"])
    return P.outside_count(P.colorize_points(c.image_positions(c.points), blocks))

