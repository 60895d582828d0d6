"""Horizontal CRS codes and map projections as column formulas.

Formulas: J. P. Snyder, Map Projections - A Working Manual (USGS PP 1395),
Lambert conformal conic, ellipsoid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terraframe.functions.numeric import ColumnLike, col


@dataclass(frozen=True)
class Geographic:
    """Longitude and latitude in degrees."""

    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257222101


@dataclass(frozen=True)
class Conic:
    """Lambert conformal conic with two standard parallels (degrees, metres)."""

    latitude_of_origin: float
    central_meridian: float
    parallel_1: float
    parallel_2: float
    false_easting: float
    false_northing: float
    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257222101


Crs = Geographic | Conic

# The projections known by code.
KNOWN: dict[int, Crs] = {
    4326: Geographic(inverse_flattening=298.257223563),
    4171: Geographic(),
    2154: Conic(46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0),
}
# The same projection as 2154 written with the WGS 84 ellipsoid.
LAMBERT_WGS84 = Conic(
    46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0, inverse_flattening=298.257223563
)

_QUARTER = math.pi / 4
_LATITUDE_PASSES = 6


@dataclass(frozen=True)
class _Cone:
    n: float
    scale: float
    rho0: float
    e: float


def _cone(crs: Conic) -> _Cone:
    flat = 1.0 / crs.inverse_flattening
    e = math.sqrt(2 * flat - flat * flat)

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    def t(phi: float) -> float:
        return math.tan(_QUARTER - phi / 2) * math.exp(e * math.atanh(e * math.sin(phi)))

    p1, p2 = math.radians(crs.parallel_1), math.radians(crs.parallel_2)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    scale = crs.semi_major * m(p1) / (n * t(p1) ** n)
    return _Cone(n, scale, scale * t(math.radians(crs.latitude_of_origin)) ** n, e)


def cone_constants(crs: Conic) -> dict[str, float]:
    """Derived constants, for users who write the formula in SQL."""
    cone = _cone(crs)
    return {"n": cone.n, "scale": cone.scale, "rho0": cone.rho0, "e": cone.e}


def _project(lon: Column, lat: Column, crs: Conic) -> tuple[Column, Column]:
    cone = _cone(crs)
    phi = F.radians(lat)
    t = F.tan(F.lit(_QUARTER) - phi / 2) * F.exp(F.lit(cone.e) * F.atanh(F.lit(cone.e) * F.sin(phi)))
    rho = F.lit(cone.scale) * F.pow(t, F.lit(cone.n))
    theta = F.lit(cone.n) * F.radians(lon - crs.central_meridian)
    return (
        F.lit(crs.false_easting) + rho * F.sin(theta),
        F.lit(crs.false_northing) + F.lit(cone.rho0) - rho * F.cos(theta),
    )


def _unproject(x: Column, y: Column, crs: Conic) -> tuple[Column, Column]:
    cone = _cone(crs)
    dx = x - crs.false_easting
    dy = F.lit(cone.rho0) - (y - crs.false_northing)
    rho = F.sqrt(dx * dx + dy * dy)
    t = F.pow(rho / cone.scale, F.lit(1.0 / cone.n))
    theta = F.atan2(dx, dy)
    phi = F.lit(math.pi / 2) - F.atan(t) * 2
    # The latitude appears once per pass, so the expression grows linearly.
    for _ in range(_LATITUDE_PASSES):
        bend = F.exp(-F.lit(cone.e) * F.atanh(F.lit(cone.e) * F.sin(phi)))
        phi = F.lit(math.pi / 2) - F.atan(t * bend) * 2
    return F.degrees(theta / cone.n) + crs.central_meridian, F.degrees(phi)


def resolve(crs: Crs | int) -> Crs:
    if isinstance(crs, int):
        if crs not in KNOWN:
            raise ValueError(f"unknown CRS code {crs}; pass its parameters instead")
        return KNOWN[crs]
    return crs


def reproject(
    x: ColumnLike, y: ColumnLike, source: Crs | int, target: Crs | int
) -> tuple[Column, Column]:
    """x, y in another CRS. The datums are taken as coincident."""
    src, dst = resolve(source), resolve(target)
    cx, cy = col(x), col(y)
    if src == dst:
        return cx, cy
    if isinstance(src, Conic):
        cx, cy = _unproject(cx, cy, src)
    if isinstance(dst, Conic):
        cx, cy = _project(cx, cy, dst)
    return cx, cy


def _project_arrays(lon: np.ndarray, lat: np.ndarray, crs: Conic) -> tuple[np.ndarray, np.ndarray]:
    cone = _cone(crs)
    phi = np.radians(lat)
    bend = cone.e * np.sin(phi)
    t = np.tan(_QUARTER - phi / 2) * np.power((1 + bend) / (1 - bend), cone.e / 2)
    rho = cone.scale * np.power(t, cone.n)
    theta = cone.n * np.radians(lon - crs.central_meridian)
    return crs.false_easting + rho * np.sin(theta), crs.false_northing + cone.rho0 - rho * np.cos(theta)


def _unproject_arrays(x: np.ndarray, y: np.ndarray, crs: Conic) -> tuple[np.ndarray, np.ndarray]:
    cone = _cone(crs)
    dx = x - crs.false_easting
    dy = cone.rho0 - (y - crs.false_northing)
    t = np.power(np.sqrt(dx * dx + dy * dy) / cone.scale, 1.0 / cone.n)
    phi = math.pi / 2 - 2 * np.arctan(t)
    for _ in range(_LATITUDE_PASSES):
        phi = math.pi / 2 - 2 * np.arctan(t * np.exp(-cone.e * np.arctanh(cone.e * np.sin(phi))))
    return np.degrees(np.arctan2(dx, dy) / cone.n) + crs.central_meridian, np.degrees(phi)


def reproject_batches(x: ColumnLike, y: ColumnLike, source: Crs | int, target: Crs | int) -> Column:
    """As ``reproject``, as a struct (x, y) worked out in Arrow batches with the C library's functions.

    Those are closer to the exact value than the virtual machine's (half a unit in the last place for most), and it matters where a place is
    taken there and back onto the centre of a pixel whose neighbours are unknown.
    """
    src, dst = resolve(source), resolve(target)
    cx, cy = col(x), col(y)
    if src == dst:
        return F.struct(cx.alias("x"), cy.alias("y"))

    @F.pandas_udf("x double, y double")
    def moved(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        px, py = x.to_numpy(float), y.to_numpy(float)
        if isinstance(src, Conic):
            px, py = _unproject_arrays(px, py, src)
        if isinstance(dst, Conic):
            px, py = _project_arrays(px, py, dst)
        return pd.DataFrame({"x": px, "y": py})

    return F.when(cx.isNotNull() & cy.isNotNull(), moved(cx, cy))


def is_geographic(crs: Crs | int) -> bool:
    return isinstance(resolve(crs), Geographic)


def horizontal_epsg(text: ColumnLike) -> Column:
    """Horizontal EPSG code declared by a CRS text, 0 if there is none.

    Understands ``EPSG:2154``, ``EPSG:2154+5720`` and WKT. In a WKT the
    authority of the CRS itself is the last one; of a compound CRS, the last
    one before its vertical part.
    """
    t = F.trim(col(text))
    short = F.regexp_extract(t, r"(?i)^EPSG:(\d+)", 1)
    horizontal = F.regexp_replace(t, r"(?is),?\s*VERT_?(CS|CRS|ICALCRS)\s*\[.*$", "")
    code = F.regexp_extract(
        horizontal, r'(?is)(?:AUTHORITY\s*\[\s*"EPSG"\s*,\s*"?|ID\s*\[\s*"EPSG"\s*,\s*"?)(\d+)"?\s*\]\s*\]*\s*$', 1
    )
    found = F.when(short != "", short).when(code != "", code)
    return F.coalesce(found.cast("int"), F.lit(0))
