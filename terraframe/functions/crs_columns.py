"""CRS texts as columns of projection parameters, and a projection that takes them per row.

Formulas: J. P. Snyder, Map Projections - A Working Manual (USGS PP 1395),
Lambert conformal conic with two standard parallels, ellipsoid. Datums are
taken as coincident. Everything is a column expression: a table may hold a
different CRS in each row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraframe.functions.crs import KNOWN, Conic, Crs, Geographic, horizontal_epsg, resolve
from terraframe.functions.numeric import ColumnLike, col

# Grid of the "same in practice" test, and how far a point may move (metres, degrees).
SAMPLES, METRES, DEGREES = 5, 1e-3, 1e-8

_NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
# Names of each parameter in WKT 1, WKT 2 and PROJ strings.
_NAMES = {
    "lat0": ("latitude_of_origin", "Latitude of false origin", "lat_0"),
    "lon0": ("central_meridian", "Longitude of false origin", "lon_0"),
    "lat1": ("standard_parallel_1", "Latitude of 1st standard parallel", "lat_1"),
    "lat2": ("standard_parallel_2", "Latitude of 2nd standard parallel", "lat_2"),
    "x0": ("false_easting", "Easting at false origin", "x_0"),
    "y0": ("false_northing", "Northing at false origin", "y_0"),
}
# Inverse flattening of the ellipsoids that PROJ strings name (semi-major axis 6378137 m).
_ELLIPSOIDS = {"GRS80": 298.257222101, "WGS84": 298.257223563}
_FIELDS = ("semi_major", "inverse_flattening", *_NAMES)


def _literal(crs: Crs) -> Column:
    conic = isinstance(crs, Conic)
    values = {
        "lat0": crs.latitude_of_origin if conic else None,
        "lon0": crs.central_meridian if conic else None,
        "lat1": crs.parallel_1 if conic else None,
        "lat2": crs.parallel_2 if conic else None,
        "x0": crs.false_easting if conic else None,
        "y0": crs.false_northing if conic else None,
        "semi_major": crs.semi_major,
        "inverse_flattening": crs.inverse_flattening,
    }
    fields = [F.lit(values[k]).cast("double").alias(k) for k in _FIELDS]
    return F.struct(F.lit(not conic).alias("geographic"), *fields)


def known_parameters(crs: Crs | int) -> Column:
    """The parameters of a given CRS as a literal, in the form of ``crs_parameters``."""
    return _literal(resolve(crs))


def crs_parameters(text: ColumnLike) -> Column:
    """struct(geographic, semi_major, inverse_flattening, lat0, lon0, lat1, lat2, x0, y0) of a CRS text, null if it is not understood.

    Texts: ``EPSG:code`` and WKT with the code of a known CRS; WKT 1 and 2
    and PROJ strings of geographic CRSs in degrees and of Lambert conformal
    conics with two standard parallels in metres.
    """
    t = F.trim(col(text))
    horizontal = F.regexp_replace(t, r"(?is),?\s*VERT_?(CS|CRS|ICALCRS)\s*\[.*$", "")

    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(horizontal, pattern, 1), F.lit("")).cast("double")

    def parameter(name: str) -> Column:
        wkt1, wkt2, proj = _NAMES[name]
        return F.coalesce(
            number(rf'(?i)PARAMETER\s*\[\s*"(?:{wkt1}|{wkt2})"\s*,\s*{_NUMBER}'), number(rf"(?:^|\s)\+{proj}=\s*{_NUMBER}")
        )

    spheroid = r'(?i)(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"\s*,\s*'
    flattening = F.coalesce(
        number(spheroid + _NUMBER.replace("(", "(?:", 1) + r"\s*,\s*" + _NUMBER),
        number(r"\+rf=\s*" + _NUMBER),
        *(F.when(horizontal.rlike(rf"(?i)\+(?:ellps|datum)={k}\b"), F.lit(v)) for k, v in _ELLIPSOIDS.items()),
    )
    axis = F.coalesce(number(spheroid + _NUMBER), number(r"\+a=\s*" + _NUMBER), F.when(horizontal.rlike(r"(?i)\+(?:ellps|datum)="), F.lit(6378137.0)))
    geographic = horizontal.rlike(r"(?is)^\s*(?:GEOGCS|GEOGCRS|GEODCRS|GEOGRAPHICCRS)\s*\[") | horizontal.rlike(r"(?i)\+proj=(?:longlat|latlong)\b")
    conic = horizontal.rlike(r"(?i)Lambert[_ ]Conformal[_ ]Conic[_ ]2SP|Lambert Conic Conformal \(2SP\)") | horizontal.rlike(r"(?i)\+proj=lcc\b")
    feet = horizontal.rlike(r'(?i)(?:LENGTH)?UNIT\s*\[\s*"[^"]*(?:foot|feet)') | horizontal.rlike(r"\+(?:units=(?!m\b)|to_meter=)")
    fields = {"semi_major": axis, "inverse_flattening": flattening} | {k: parameter(k) for k in _NAMES}
    complete = axis.isNotNull() & flattening.isNotNull()
    cone = complete & ~feet
    for k in _NAMES:
        cone = cone & fields[k].isNotNull()
    written = F.struct(geographic.alias("geographic"), *(fields[k].cast("double").alias(k) for k in _FIELDS))
    value = F.when((geographic & complete) | (conic & cone), written)

    def by_code(code: Column) -> Column:
        found = value
        for number_, crs in KNOWN.items():
            found = F.when(code == number_, _literal(crs)).otherwise(found)
        return found

    return _let(horizontal_epsg(t), by_code)


def _eccentricity(p: Column) -> Column:
    flat = 1 / p["inverse_flattening"]
    return F.sqrt(2 * flat - flat * flat)


def _t(phi: Column, e: Column) -> Column:
    return F.tan(F.lit(math.pi / 4) - phi / 2) * F.exp(e * F.atanh(e * F.sin(phi)))


def cone(p: Column) -> Column:
    """struct(n, scale, rho0, e): constants of the cone with parameters ``p``; compute it once a row."""
    e = _eccentricity(p)

    def m(phi: Column) -> Column:
        return F.cos(phi) / F.sqrt(1 - F.pow(e * F.sin(phi), 2))

    p1, p2 = F.radians(p["lat1"]), F.radians(p["lat2"])
    two = (F.log(m(p1)) - F.log(m(p2))) / (F.log(_t(p1, e)) - F.log(_t(p2, e)))
    n = F.when(p1 == p2, F.sin(p1)).otherwise(two)
    scale = p["semi_major"] * m(p1) / (n * F.pow(_t(p1, e), n))
    rho0 = scale * F.pow(_t(F.radians(p["lat0"]), e), n)
    return F.struct(n.alias("n"), scale.alias("scale"), rho0.alias("rho0"), e.alias("e"))


def to_degrees(x: Column, y: Column, p: Column, k: Column) -> tuple[Column, Column]:
    """Longitude and latitude of metres in the cone ``k`` with parameters ``p``."""
    dx, dy = x - p["x0"], k["rho0"] - (y - p["y0"])
    rho = F.sqrt(dx * dx + dy * dy)
    t = F.pow(rho / k["scale"], 1 / k["n"])
    phi = F.lit(math.pi / 2) - F.atan(t) * 2
    # The latitude appears once per pass, so the expression grows linearly.
    for _ in range(6):
        phi = F.lit(math.pi / 2) - F.atan(t * F.exp(-k["e"] * F.atanh(k["e"] * F.sin(phi)))) * 2
    return F.degrees(F.atan2(dx, dy) / k["n"]) + p["lon0"], F.degrees(phi)


def to_metres(lon: Column, lat: Column, p: Column, k: Column) -> tuple[Column, Column]:
    rho = k["scale"] * F.pow(_t(F.radians(lat), k["e"]), k["n"])
    theta = k["n"] * F.radians(lon - p["lon0"])
    return p["x0"] + rho * F.sin(theta), p["y0"] + k["rho0"] - rho * F.cos(theta)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once a row however often it is used."""
    return F.transform(F.array(value), body)[0]


def moved_over(box: Column, source: Column, target: Column) -> Column:
    """How far a 5 x 5 grid of points over ``box`` (minx, miny, maxx, maxy) moves from one CRS to the other, at most.

    source, target: structs of ``crs_parameters``; null where one of them or
    the box is, or where their kinds (degrees, metres) differ. In the unit of both.
    """
    last = F.lit(float(SAMPLES - 1))

    def of(s: Column) -> Column:
        def at(i: Column, k: Column) -> Column:
            x = s["b"]["minx"] + (s["b"]["maxx"] - s["b"]["minx"]) * (i % SAMPLES) / last
            y = s["b"]["miny"] + (s["b"]["maxy"] - s["b"]["miny"]) * F.floor(i / SAMPLES) / last

            def moved(p: Column) -> Column:
                lon, lat = to_degrees(p["x"], p["y"], s["from"], k["from"])
                there = _let(F.struct(lon.alias("lon"), lat.alias("lat")), lambda d: F.struct(*to_metres(d["lon"], d["lat"], s["to"], k["to"])))
                return _let(there, lambda n: F.greatest(F.abs(n["col1"] - p["x"]), F.abs(n["col2"] - p["y"])))

            return _let(F.struct(x.alias("x"), y.alias("y")), moved)

        cones = F.struct(cone(s["from"]).alias("from"), cone(s["to"]).alias("to"))
        numbers = F.sequence(F.lit(0), F.lit(SAMPLES * SAMPLES - 1))
        metres = _let(cones, lambda k: F.array_max(F.transform(numbers, lambda i: at(i, k))))
        alike = s["from"]["geographic"] == s["to"]["geographic"]
        return F.when(alike & s["b"].isNotNull(), F.when(s["from"]["geographic"], F.lit(0.0)).otherwise(metres))

    return _let(F.struct(box.alias("b"), source.alias("from"), target.alias("to")), of)


def same_crs(a: ColumnLike, b: ColumnLike, box: Column) -> Column:
    """Whether two CRS texts name one horizontal CRS, by code, by text, or in practice over ``box``.

    In practice: no point of a grid over the box moves by more than 1 mm
    (1e-8 degrees). Texts that are neither equal nor understood differ; a null text is no CRS.
    """
    a, b = col(a), col(b)
    codes = F.struct(horizontal_epsg(a).alias("a"), horizontal_epsg(b).alias("b"))
    declared = _let(codes, lambda k: (k["a"] != 0) & (k["a"] == k["b"])) | (F.trim(a) == F.trim(b))

    def practice(p: Column) -> Column:
        limit = F.when(p["b"]["geographic"], F.lit(DEGREES)).otherwise(F.lit(METRES))
        return moved_over(p["box"], p["a"], p["b"]) <= limit

    parameters = F.struct(box.alias("box"), crs_parameters(a).alias("a"), crs_parameters(b).alias("b"))
    return F.coalesce(declared, F.lit(False)) | F.coalesce(_let(parameters, practice), F.lit(False))
