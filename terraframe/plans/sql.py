"""The collection of :mod:`terraframe.plans.collection` in SQL, for checking results.

Named sub-queries; ``with_sql("dsm", "bounds")`` gives a WITH clause of the
named ones and all they need.
"""

from __future__ import annotations

import re


def fixed(expression: str) -> str:
    """Six decimals as an integer: comparable across engines."""
    return f"CAST(floor(({expression}) * 1e6 + 0.5e0) AS BIGINT)"


def pixel_of(x: str, y: str, g: str = "") -> tuple[str, str]:
    """World to fractional pixel with affine columns a..f of alias ``g``."""
    p = f"{g}." if g else ""
    det = f"({p}a*{p}e - {p}b*{p}d)"
    dx, dy = f"(({x}) - {p}c)", f"(({y}) - {p}f)"
    return f"(({p}e*{dx} - {p}b*{dy})/{det})", f"(({p}a*{dy} - {p}d*{dx})/{det})"


def clamp(v: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {v}))"


def lround(v: str) -> str:
    return f"CAST(CASE WHEN {v} < 0 THEN -floor(0.5e0 - ({v})) ELSE floor({v} + 0.5e0) END AS INTEGER)"


def scene_of(x: str, y: str, z: str, f: str = "fr") -> tuple[str, str, str]:
    return (
        f"(({x}) - {f}.cx)/{f}.scale",
        f"(({z}) - {f}.cz)/{f}.scale",
        f"(-(({y}) - {f}.cy)/{f}.scale)",
    )


def _catalog(pixel: str, inset: str, size: int) -> str:
    return (
        f"SELECT raster_id, {pixel} AS a, 0e0 AS b, x0 + {inset} AS c, 0e0 AS d, -{pixel} AS e, "
        f"y0 + (250e0 - {inset}) AS f, {size} AS width, {size} AS height FROM squares"
    )


def _raster(catalog: str, value: str, how: str) -> str:
    px, py = pixel_of("p.x", "p.y", "k")
    return f"""
      SELECT g.raster_id, g.row, g.col, m.v FROM (
        SELECT k.raster_id, CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col
        FROM {catalog} k, range(25) r(i), range(25) c(i) WHERE r.i < k.height AND c.i < k.width) g
      LEFT JOIN (
        SELECT k.raster_id,
          CAST(floor({py} + 0.5e0) AS INTEGER) AS row, CAST(floor({px} + 0.5e0) AS INTEGER) AS col, {how}({value}) AS v
        FROM pts p JOIN {catalog} k ON k.raster_id = p.file_id GROUP BY ALL) m
      USING (raster_id, row, col)"""


def _filled(raster: str, catalog: str) -> str:
    """Nearest known pixel by brute force over each raster."""
    return f"""
      SELECT p.raster_id, p.row, p.col, p.v, coalesce(p.v, n.v) AS filled FROM {raster} p LEFT JOIN (
        SELECT g.raster_id, g.row, g.col,
          min_by(s.v, (abs(g.row - s.row) + abs(g.col - s.col)) * 1000000 + s.row * 1000 + s.col) AS v
        FROM {raster} g JOIN {raster} s ON s.raster_id = g.raster_id AND s.v IS NOT NULL
        WHERE g.v IS NULL GROUP BY ALL) n USING (raster_id, row, col)"""


def _extent(catalog: str) -> str:
    return (
        f"SELECT raster_id, least(c, c + a*(width-1)) AS minx, greatest(c, c + a*(width-1)) AS maxx, "
        f"least(f, f + e*(height-1)) AS miny, greatest(f, f + e*(height-1)) AS maxy FROM {catalog}"
    )


def _tile(v: str) -> str:
    w = f"((b.max{v} - b.min{v})/8e0)"
    g = f"least(7, greatest(0, floor((p.{v} - b.min{v})/{w})))"
    return (
        f"CAST(CASE WHEN {g} > 0 AND p.{v} < b.min{v} + {g}*{w} THEN {g} - 1 "
        f"WHEN {g} < 7 AND p.{v} >= b.min{v} + ({g}+1)*{w} THEN {g} + 1 ELSE {g} END AS INTEGER)"
    )


def eigen(source: str, keys: str) -> str:
    """Eigenvalues by the trigonometric form of the cubic."""
    return f"""
      SELECT *, 3*q - l1 - l3 AS l2 FROM (
       SELECT *, q + 2*p*cos(phi) AS l1, q + 2*p*cos(phi + 2*pi()/3) AS l3 FROM (
        SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1e0, least(1e0,
            ((c00-q)*((c11-q)*(c22-q) - c12*c12) - c01*(c01*(c22-q) - c12*c02)
             + c02*(c01*c12 - (c11-q)*c02)) / (p*p*p) / 2))) / 3 ELSE 0e0 END AS phi FROM (
         SELECT *, sqrt(((c00-q)*(c00-q) + (c11-q)*(c11-q) + (c22-q)*(c22-q)
            + 2*(c01*c01 + c02*c02 + c12*c12))/6) AS p FROM (
          SELECT *, (c00+c11+c22)/3 AS q FROM {source}))))"""


def moments(x: str, y: str, z: str) -> str:
    return (
        f"var_pop({x}) AS c00, covar_pop({x},{y}) AS c01, covar_pop({x},{z}) AS c02, "
        f"var_pop({y}) AS c11, covar_pop({y},{z}) AS c12, var_pop({z}) AS c22"
    )


# The colour stops of the ramps.
STOPS5 = [(0.1, 0.2, 0.8), (0.2, 0.7, 0.9), (0.3, 0.8, 0.3), (0.95, 0.85, 0.2), (0.85, 0.25, 0.2)]
STOPS3 = [(0.267, 0.005, 0.329), (0.128, 0.567, 0.551), (0.993, 0.906, 0.144)]


def ramp(t: str, stops: list, channel: int) -> str:
    n = len(stops) - 1
    s = f"(greatest(0e0, least(1e0, {t}))*{n})"
    cases = " ".join(
        f"WHEN {s} < {i + 1} THEN {stops[i][channel]}e0*(1-({s}-{i})) + {stops[i + 1][channel]}e0*({s}-{i})"
        for i in range(n)
    )
    return f"(CASE {cases} ELSE {stops[-1][channel]}e0 END)"


NEIGHBOURS = "(VALUES (0,0),(0,1),(1,0),(1,1)) n(dr,dc)"


def resample(targets: str, source: str, value: str = "v") -> str:
    """Rule for rasters with gaps. ``targets``: keys, raster_id, px, py, width, height."""
    return f"""
      SELECT t.*, s.sample FROM {targets} t LEFT JOIN (
        SELECT t.tid, CASE WHEN sum(w) FILTER (s.{value} IS NOT NULL AND w > 0) > 0
            THEN sum(w*s.{value}) FILTER (s.{value} IS NOT NULL AND w > 0)
               / sum(w) FILTER (s.{value} IS NOT NULL AND w > 0) END AS sample
        FROM (SELECT *, r0 + n.dr AS sr, c0 + n.dc AS sc,
            CASE WHEN n.dr = 0 THEN 1 - fy ELSE fy END * CASE WHEN n.dc = 0 THEN 1 - fx ELSE fx END AS w
          FROM (SELECT *, cc - c0 AS fx, rr - r0 AS fy FROM (
            SELECT *, floor(cc) AS c0, floor(rr) AS r0 FROM (
              SELECT tid, raster_id, greatest(0e0, least(width - 1e0, px)) AS cc,
                greatest(0e0, least(height - 1e0, py)) AS rr FROM {targets}
              WHERE px >= -0.5e0 AND px <= width - 0.5e0 AND py >= -0.5e0 AND py <= height - 0.5e0))),
          {NEIGHBOURS}) t
        JOIN {source} s ON s.raster_id = t.raster_id AND s.row = t.sr AND s.col = t.sc
        GROUP BY t.tid) s ON s.tid = t.tid"""


def ground(targets: str, source: str) -> str:
    """Strict ground rule. ``source`` has v and filled."""
    return f"""
      SELECT t.*, s.ground FROM {targets} t LEFT JOIN (
        SELECT t.tid, CASE WHEN any_value(near.v) IS NOT NULL THEN sum(w*s.filled) END AS ground
        FROM (SELECT *, CASE WHEN n.dr = 0 THEN 1 - fy ELSE fy END
                      * CASE WHEN n.dc = 0 THEN 1 - fx ELSE fx END AS w
          FROM (SELECT *, px - c0 AS fx, py - r0 AS fy FROM (
            SELECT *, least(floor(px), width - 2) AS c0, least(floor(py), height - 2) AS r0
            FROM {targets}
            WHERE px >= 0 AND py >= 0 AND px <= width - 1 AND py <= height - 1)), {NEIGHBOURS}) t
        JOIN {source} s ON s.raster_id = t.raster_id AND s.row = t.r0 + t.dr AND s.col = t.c0 + t.dc
        LEFT JOIN {source} near ON near.raster_id = t.raster_id
          AND near.row = {lround("t.py")} AND near.col = {lround("t.px")} AND near.v IS NOT NULL
        GROUP BY t.tid) s ON s.tid = t.tid"""


_DTM_ON_DSM = pixel_of("g.c + g.a*p.col + g.b*p.row", "g.f + g.d*p.col + g.e*p.row", "s")


def on_raster(grid: str, grid_catalog: str, source_catalog: str) -> str:
    """Pixels of one raster as fractional pixels of the one with the same id."""
    px, py = _DTM_ON_DSM
    return f"""
      SELECT (p.raster_id*100 + p.row)*100 + p.col AS tid, p.raster_id, p.row, p.col, p.v,
        {px} AS px, {py} AS py, s.width, s.height
      FROM {grid} p JOIN {grid_catalog} g USING (raster_id) JOIN {source_catalog} s USING (raster_id)"""


_SX, _SY, _SZ = scene_of("p.x", "p.y", "p.z")
_TILE4 = {
    v: (
        f"CAST(CASE WHEN g{v} > 0 AND {v} < min{v} + g{v}*w{v} THEN g{v} - 1 "
        f"WHEN g{v} < 3 AND {v} >= min{v} + (g{v}+1)*w{v} THEN g{v} + 1 ELSE g{v} END AS INTEGER)"
    )
    for v in "xy"
}
_IPX, _IPY = pixel_of("p.x", "p.y", "k")

CTES: dict[str, str] = {
    "pts": """
      SELECT l_suppkey AS file_id,
        ((l_orderkey*8 + l_linenumber)*1000000 + l_partkey)*64 + CAST(floor(l_quantity) AS BIGINT) AS file_idx,
        CAST(l_suppkey % 32 AS DOUBLE)*250e0 + CAST(l_orderkey % 997 AS DOUBLE)*0.25e0
          + l_linenumber*0.01e0 AS x,
        CAST(l_suppkey // 32 AS DOUBLE)*250e0 + CAST(l_partkey % 499 AS DOUBLE)*0.5e0 AS y,
        l_quantity + l_discount*10e0 AS z,
        CAST(l_orderkey*37 % 65536 AS INTEGER) AS red, CAST(l_partkey*101 % 65536 AS INTEGER) AS green,
        CAST(l_suppkey*977 % 65536 AS INTEGER) AS blue
      FROM lineitem""",
    "bounds": """
      SELECT file_id, count(*) AS point_count, min(x) AS minx, min(y) AS miny, min(z) AS minz,
        max(x) AS maxx, max(y) AS maxy, max(z) AS maxz FROM pts GROUP BY file_id""",
    "frame": """
      SELECT (minx+maxx)*0.5e0 AS cx, (miny+maxy)*0.5e0 AS cy, (minz+maxz)*0.5e0 AS cz,
        CASE WHEN diag < 1e-9 THEN 1e0 ELSE diag END AS scale, minz AS zmin,
        CASE WHEN maxz - minz > 1e-9 THEN maxz ELSE minz + 1e0 END AS zmax FROM (
        SELECT *, sqrt((maxx-minx)*(maxx-minx) + (maxy-miny)*(maxy-miny) + (maxz-minz)*(maxz-minz)) AS diag
        FROM (SELECT min(minx) AS minx, min(miny) AS miny, min(minz) AS minz, max(maxx) AS maxx,
          max(maxy) AS maxy, max(maxz) AS maxz FROM bounds))""",
    "squares": """
      SELECT s_suppkey AS raster_id, CAST(s_suppkey % 32 AS DOUBLE)*250e0 AS x0,
        CAST(s_suppkey // 32 AS DOUBLE)*250e0 AS y0 FROM supplier""",
    "dsm_catalog": _catalog("10e0", "5e0", 25),
    "dtm_catalog": _catalog("25e0", "12.5e0", 10),
    "dhm_catalog": _catalog("12.5e0", "6.25e0", 20),
    "image_catalog": _catalog("5e0", "7.5e0", 46),
    "dsm": _raster("dsm_catalog", "p.z", "max"),
    "dtm": _raster("dtm_catalog", "p.z", "min"),
    "dhm": _raster("dhm_catalog", "p.z - floor(p.z) - 0.3e0", "max"),
    "dsm_filled": _filled("dsm", "dsm_catalog"),
    "dtm_filled": _filled("dtm", "dtm_catalog"),
    "image": """
      SELECT raster_id, CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col,
        CAST((r.i*7 + c.i*13 + raster_id*29) % 256 AS INTEGER) AS r,
        CAST((r.i*11 + c.i*5 + raster_id*31) % 256 AS INTEGER) AS g,
        CAST((r.i*3 + c.i*17 + raster_id*37) % 256 AS INTEGER) AS b, 255 AS a
      FROM image_catalog, range(46) r(i), range(46) c(i)""",
    "dsm_box": _extent("dsm_catalog"),
    "dtm_box": _extent("dtm_catalog"),
    "dhm_box": _extent("dhm_catalog"),
    "image_box": _extent("image_catalog"),
    "tiled": f"SELECT p.*, {_tile('x')} AS gx, {_tile('y')} AS gy FROM pts p JOIN bounds b USING (file_id)",
    "pca": f"""
      SELECT file_id, gx, gy, count(*) AS n, min(z) AS minz, max(z) AS maxz, {moments("x", "y", "z")}
      FROM tiled GROUP BY file_id, gx, gy""",
    "pca_eigen": eigen("pca", ""),
    "image_points": f"""
      SELECT p.*, p.file_idx*1000 + p.file_id AS tid, k.raster_id, {_IPX} AS px, {_IPY} AS py, k.width, k.height
      FROM pts p JOIN image_catalog k ON k.raster_id = p.file_id""",
    "coloured": f"""
      SELECT t.*, t.inside IS NOT TRUE AS outside, coalesce(s.ored, 0.35e0) AS ored,
        coalesce(s.ogreen, 0.35e0) AS ogreen, coalesce(s.oblue, 0.35e0) AS oblue
      FROM (SELECT *, px >= 0 AND px < width AND py >= 0 AND py < height AS inside FROM image_points) t
      LEFT JOIN (
        SELECT t.file_id, t.file_idx, sum(m.r/255e0*w) AS ored, sum(m.g/255e0*w) AS ogreen, sum(m.b/255e0*w) AS oblue
        FROM (SELECT *, CASE WHEN n.dr = 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END
             * CASE WHEN n.dc = 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END AS w,
             least(floor(py) + n.dr, height - 1) AS sr, least(floor(px) + n.dc, width - 1) AS sc
           FROM image_points, {NEIGHBOURS}
           WHERE px >= 0 AND px < width AND py >= 0 AND py < height) t
        JOIN image m ON m.raster_id = t.raster_id AND m.row = t.sr AND m.col = t.sc
        GROUP BY t.file_id, t.file_idx) s USING (file_id, file_idx)""",
    "dtm_on_dsm": on_raster("dsm", "dsm_catalog", "dtm_catalog"),
    "dsm_on_dtm": on_raster("dtm", "dtm_catalog", "dsm_catalog"),
    "dhm_on_dtm": on_raster("dtm", "dtm_catalog", "dhm_catalog"),
    "dtm_on_dhm": on_raster("dhm", "dhm_catalog", "dtm_catalog"),
    "dsm_ground": resample("dtm_on_dsm", "dtm"),
    "dtm_dsm": resample("dsm_on_dtm", "dsm"),
    "dtm_dhm": resample("dhm_on_dtm", "dhm"),
    "dhm_ground": resample("dtm_on_dhm", "dtm"),
    "views": """
      SELECT *, tx + dist*cos(pitch)*sin(yaw) AS ex, ty + dist*sin(pitch) AS ey,
        tz + dist*cos(pitch)*cos(yaw) AS ez FROM (
        SELECT raster_id AS view_id, (x0 + 125e0 - fr.cx)/fr.scale AS tx, (25e0 - fr.cz)/fr.scale AS ty,
          -((y0 + 125e0) - fr.cy)/fr.scale AS tz, raster_id*0.7e0 AS yaw,
          0.2e0 + (raster_id % 10)*0.1e0 AS pitch, (40e0 + (raster_id % 7)*30e0)/fr.scale AS dist
        FROM squares, frame fr)""",
    "scene_moments": f"""
      SELECT file_id, gx, gy, count(*) AS n, min(sy) AS minz, max(sy) AS maxz, {moments("sx", "sy", "sz")}
      FROM (SELECT file_id, {_TILE4["x"]} AS gx, {_TILE4["y"]} AS gy, sx, sy, sz FROM (
        SELECT *, least(3, greatest(0, floor((x-minx)/wx))) AS gx, least(3, greatest(0, floor((y-miny)/wy))) AS gy
        FROM (SELECT p.file_id, p.x, p.y, b.minx, b.miny, (b.maxx-b.minx)/4e0 AS wx, (b.maxy-b.miny)/4e0 AS wy,
          {_SX} AS sx, {_SY} AS sy, {_SZ} AS sz FROM pts p JOIN bounds b USING (file_id), frame fr)))
      GROUP BY ALL""",
    "scene_eigen": eigen("scene_moments", ""),
}


def with_sql(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause of the named sub-queries and everything they use, in order."""
    available = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in available:
            if other != name and re.search(rf"\b(?:FROM|JOIN|,)\s+{other}\b", available[name]):
                visit(other)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({available[n].strip()})" for n in ordered)
    return f"WITH {parts}\n"
