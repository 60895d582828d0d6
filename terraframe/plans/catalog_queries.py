"""Queries on catalogs: frame, CRS, pairing, coverage, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions import frame, rules
from terraframe.functions.crs import horizontal_epsg
from terraframe.functions.crs_columns import crs_parameters
from terraframe.operators import catalog as K
from terraframe.operators.boxes import box
from terraframe.operators.lookup import join_catalog
from terraframe.plans.collection import Collection
from terraframe.plans.registry import fixed_as, query
from terraframe.plans.sql import clamp, fixed as q, with_sql

WKT = (
    'COMPD_CS["x",PROJCS["RGF93 / Lambert-93",GEOGCS["RGF93",AUTHORITY["EPSG","4171"]],'
    'AUTHORITY["EPSG","2154"]],VERT_CS["NGF-IGN69 height",AUTHORITY["EPSG","5720"]]]'
)
SITE, MINE = 'LOCAL_CS["site grid"]', 'LOCAL_CS["mine grid"]'
# One custom cone, spelt twice, and the projection of EPSG:2154 on another ellipsoid, without a code.
CONE = (
    'PROJCS["valley",GEOGCS["g",DATUM["d",SPHEROID["GRS 1980",6378137,298.257222101]],UNIT["degree",0.0174532925199433]],'
    'PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",45.5],PARAMETER["standard_parallel_2",46.75],'
    'PARAMETER["latitude_of_origin",46],PARAMETER["central_meridian",6.25],PARAMETER["false_easting",500000],'
    'PARAMETER["false_northing",1000000.5],UNIT["metre",1]]'
)
CONE_PROJ = "+proj=lcc +lat_0=46.0 +lon_0=6.25 +lat_1=45.5 +lat_2=46.75 +x_0=5e5 +y_0=1000000.5 +ellps=GRS80 +units=m +no_defs"
LAMBERT_PROJ = "+proj=lcc +lat_0=46.5 +lon_0=3 +lat_1=49 +lat_2=44 +x_0=700000 +y_0=6600000 +ellps=WGS84 +units=m"
TEXTS = ["EPSG:2154", "EPSG:2154+5720", WKT, CONE, "", "EPSG:4326", SITE, MINE, CONE_PROJ, LAMBERT_PROJ]

_INPUTS_SQL = f"""
 SELECT s_suppkey AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'cloud' WHEN 1 THEN 'dem' ELSE 'ortho' END AS kind,
  s_nationkey AS scene, s_suppkey % 10 AS t,
  CASE WHEN s_suppkey % 10 < 3 THEN 2154 WHEN s_suppkey % 10 = 5 THEN 4326 ELSE 0 END AS epsg
 FROM supplier"""
# One number a horizontal CRS: what is the same in practice has the same number.
_SAME = "CASE t WHEN 0 THEN 2154 WHEN 1 THEN 2154 WHEN 2 THEN 2154 WHEN 9 THEN 2154 WHEN 3 THEN 1 WHEN 8 THEN 1 ELSE -t END"


def inputs(c: Collection) -> DataFrame:
    """One declared input per supplier with its extent, grouped into one scene per nation."""
    s = F.col("s_suppkey")
    x, y = (s % 32) * 250.0 + 983000.0, F.floor(s / 32) * 250.0 + 6547000.0
    text = F.get(F.array(*map(F.lit, TEXTS)), (s % len(TEXTS)).cast("int"))
    return c.table("supplier").select(
        s.alias("ord"),
        F.when(s % 3 == 0, "cloud").when(s % 3 == 1, "dem").otherwise("ortho").alias("kind"),
        F.col("s_nationkey").alias("scene"),
        text.alias("wkt"),
        box(x, y, x + 250.0, y + 250.0).alias("box"),
    )


@query("horizontal_epsg", with_sql("inputs", extra={"inputs": _INPUTS_SQL}) + "SELECT ord, CAST(epsg AS INTEGER) AS epsg FROM inputs")
def _(c: Collection):
    return inputs(c).select("ord", horizontal_epsg("wkt").alias("epsg"))


@query(
    "scene_crs",
    with_sql("inputs", extra={"inputs": _INPUTS_SQL})
    + """SELECT CAST(epsg AS INTEGER) AS epsg, ord, kind FROM inputs WHERE t <> 4
      ORDER BY CASE kind WHEN 'cloud' THEN 0 WHEN 'dem' THEN 1 ELSE 2 END, ord LIMIT 1""",
)
def _(c: Collection):
    declared = inputs(c)
    crs = K.scene_crs(declared)
    rank = F.when(F.col("kind") == "cloud", 0).when(F.col("kind") == "dem", 1).otherwise(2)
    first = declared.where(F.col("wkt") != "").agg(
        F.min_by(F.struct("ord", "kind"), F.struct(rank, "ord")).alias("i")
    )
    scene = K.as_scalar(crs)
    return first.select(scene["epsg"].alias("epsg"), "i.ord", "i.kind")


@query(
    "crs_mismatch",
    with_sql("inputs", extra={"inputs": _INPUTS_SQL})
    + f"""SELECT ord, kind, CAST(epsg AS INTEGER) AS epsg, CASE WHEN t = 4 OR {_SAME} = (
        SELECT {_SAME} FROM inputs WHERE t <> 4
        ORDER BY CASE kind WHEN 'cloud' THEN 0 WHEN 'dem' THEN 1 ELSE 2 END, ord LIMIT 1) THEN 'none'
      WHEN kind = 'cloud' THEN 'misplaced' ELSE 'warp' END AS action FROM inputs""",
)
def _(c: Collection):
    declared = inputs(c)
    scene = K.as_scalar(K.scene_crs(declared))
    return K.crs_mismatch(declared, scene).select("ord", "kind", "epsg", "action")


@query(
    "scene_frame",
    with_sql("frame")
    + "SELECT " + ", ".join(f"{q(k)} AS {k}" for k in ("cx", "cy", "cz", "scale", "zmin", "zmax")) + " FROM frame",
)
def _(c: Collection):
    return c.frame.select(*fixed_as(**{k: k for k in ("cx", "cy", "cz", "scale", "zmin", "zmax")}))


@query(
    "union_layers",
    with_sql("bounds", "dtm_box")
    + f"""SELECT count(*) AS layers, {q('min(minx)')} AS minx, {q('max(maxx)')} AS maxx, {q('min(miny)')} AS miny,
      {q('max(maxy)')} AS maxy, {q('min(minz)')} AS minz, {q('max(maxz)')} AS maxz,
      count(*) FILTER (shown) AS visible_layers, {q('max(maxx) FILTER (shown)')} AS visible_maxx FROM (
      SELECT minx, maxx, miny, maxy, minz, maxz, file_id % 2 = 0 AS shown FROM bounds UNION ALL
      SELECT minx, maxx, miny, maxy, NULL, NULL, raster_id % 3 = 0 FROM dtm_box)""",
)
def _(c: Collection):
    clouds = c.bounds.withColumn("shown", F.col("file_id") % 2 == 0)
    rasters = c.boxes(c.dtm_catalog, "raster_id", "b").select(
        "raster_id", "b.*", (F.col("raster_id") % 3 == 0).alias("shown")
    )
    layers = K.union_bounds([clouds, rasters])
    return layers.agg(
        F.count(F.lit(1)).alias("layers"),
        *fixed_as(
            minx=F.min("minx"), maxx=F.max("maxx"), miny=F.min("miny"), maxy=F.max("maxy"),
            minz=F.min("minz"), maxz=F.max("maxz"),
        ),
        F.count_if("shown").alias("visible_layers"),
        *fixed_as(visible_maxx=F.max(F.when(F.col("shown"), F.col("maxx")))),
    )


_PAIR_AREA = "(least(a.maxx, g.maxx) - greatest(a.minx, g.minx))*(least(a.maxy, g.maxy) - greatest(a.miny, g.miny))"
_MEET = """least(a.maxx, g.maxx) > greatest(a.minx, g.minx) AND least(a.maxy, g.maxy) > greatest(a.miny, g.miny)"""
# Height models displaced by 100 m east and 60 m north, so that each overlaps
# up to four terrains.
_ABOVE = "SELECT raster_id, minx + 100e0 AS minx, maxx + 100e0 AS maxx, miny + 60e0 AS miny, maxy + 60e0 AS maxy FROM dhm_box"


def _shifted(c: Collection) -> DataFrame:
    b = F.col("b")
    boxes = c.boxes(c.dhm_catalog, "above_id", "b")
    return boxes.select(
        "above_id",
        box(b["minx"] + 100.0, b["miny"] + 60.0, b["maxx"] + 100.0, b["maxy"] + 60.0).alias("above_box"),
    )


@query(
    "pair_ground",
    with_sql("above", "dtm_box", extra={"above": _ABOVE})
    + f"""SELECT a.raster_id AS above_id, p.ground_id, {q('p.area')} AS area FROM above a LEFT JOIN (
      SELECT a.raster_id, g.raster_id AS ground_id, {_PAIR_AREA} AS area,
        row_number() OVER (PARTITION BY a.raster_id ORDER BY {_PAIR_AREA} DESC, g.raster_id) AS rk
      FROM above a JOIN dtm_box g ON {_MEET}) p ON p.raster_id = a.raster_id AND rk = 1""",
)
def _(c: Collection):
    ground = c.boxes(c.dtm_catalog, "ground_id", "ground_box").withColumn("ord", F.col("ground_id"))
    pairs = K.pair_ground(_shifted(c), ground)
    return pairs.select("above_id", "ground_id", *fixed_as(area="area"))


@query(
    "ortho_coverage",
    with_sql("bounds", "image_box")
    + f"""SELECT file_id, image_id, {q('coverage')} AS coverage, same_crs, same_crs AND coverage >= 0.25e0 AS colours
      FROM (SELECT a.file_id, g.raster_id AS image_id,
        CASE WHEN {_MEET} THEN {_PAIR_AREA} ELSE 0e0 END / ((a.maxx-a.minx)*(a.maxy-a.miny)) AS coverage,
        a.file_id % 5 = 0 OR a.file_id % 5 = 1 AND g.raster_id % 5 = 0
          OR a.file_id % 5 IN (2, 4) AND g.raster_id % 2 = 0 AND g.raster_id % 5 <> 0 AS same_crs
      FROM bounds a JOIN (SELECT raster_id, minx - (raster_id % 3)*80e0 AS minx, maxx - (raster_id % 3)*80e0 AS maxx,
        miny, maxy FROM image_box) g
      ON a.minx <= g.maxx AND a.maxx >= g.minx AND a.miny <= g.maxy AND a.maxy >= g.miny)""",
)
def _(c: Collection):
    f = F.col("file_id")
    crs = F.when(f % 5 == 0, "").when(f % 5 == 1, SITE).when(f % 5 == 2, "EPSG:2154").when(f % 5 == 3, "EPSG:27572").otherwise(LAMBERT_PROJ)
    clouds = c.bounds.select(
        "file_id",
        box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")).alias("cloud_box"),
        crs.alias("cloud_crs"),
    )
    b, shift = F.col("b"), (F.col("image_id") % 3) * 80.0
    images = c.boxes(c.image_catalog, "image_id", "b").select(
        "image_id",
        box(b["minx"] - shift, b["miny"], b["maxx"] - shift, b["maxy"]).alias("image_box"),
        F.when(F.col("image_id") % 5 == 0, SITE).when(F.col("image_id") % 2 == 0, "EPSG:2154").otherwise("EPSG:4326").alias("image_crs"),
    )
    covered = K.image_coverage(clouds, images)
    return covered.select("file_id", "image_id", *fixed_as(coverage="coverage"), "same_crs", "colours")


@query(
    "ortho_overlap",
    with_sql("dtm_box", "image_box")
    + f"""SELECT a.raster_id, count(g.raster_id) AS images,
      CASE WHEN count(g.raster_id) > 0 THEN 'image' ELSE 'ramp' END AS colour_source
      FROM dtm_box a LEFT JOIN (SELECT * FROM image_box WHERE raster_id % 3 <> 1) g ON {_MEET}
      GROUP BY a.raster_id""",
)
def _(c: Collection):
    rasters = c.boxes(c.dtm_catalog, "raster_id", "raster_box")
    # Two suppliers in three have flown an image.
    flown = c.image_catalog.where(F.col("raster_id") % 3 != 1)
    return K.image_overlap(rasters, c.boxes(flown, "image_id", "image_box"))


_FILES_SQL = """
 SELECT s_suppkey AS id, s_nationkey AS scene, CASE s_suppkey % 6 WHEN 0 THEN s_suppkey || '.laz'
   WHEN 1 THEN s_suppkey || '.copc.laz' WHEN 2 THEN s_suppkey || '.TIF' WHEN 3 THEN s_suppkey || '.tiff'
   WHEN 4 THEN s_suppkey || '-grey.tif' ELSE s_suppkey || '-height.tif' END AS path,
  CASE s_suppkey % 6 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS bands,
  CASE s_suppkey % 6 WHEN 2 THEN 'byte' WHEN 4 THEN 'byte' WHEN 3 THEN 'float' WHEN 5 THEN 'float' END AS dtype,
  CASE WHEN s_suppkey % 6 = 5 THEN 'height' END AS role FROM supplier"""


def files(c: Collection) -> DataFrame:
    """One input file per supplier, one scene per nation."""
    s = F.col("s_suppkey")

    def pick(*values) -> F.Column:
        return F.get(F.array(*(F.lit(v) for v in values)), (s % 6).cast("int"))

    return c.table("supplier").select(
        s.alias("id"),
        F.col("s_nationkey").alias("scene"),
        F.concat(s.cast("string"), pick(".laz", ".copc.laz", ".TIF", ".tiff", "-grey.tif", "-height.tif")).alias("path"),
        pick(0, 0, 3, 1, 1, 1).alias("bands"),
        pick(None, None, "byte", "float", "byte", "float").alias("dtype"),
        F.when(s % 6 == 5, "height").alias("role"),
    )


_KIND = """CASE WHEN regexp_matches(lower(path), '\\.tiff?$') THEN
   CASE WHEN bands >= 3 AND dtype = 'byte' THEN 'orthophoto' ELSE 'dem' END
  WHEN contains(path, '.copc.') THEN 'tiled_cloud' ELSE 'cloud' END"""


@query(
    "classify_inputs",
    with_sql("files", extra={"files": _FILES_SQL}) + f"SELECT id, path, {_KIND} AS kind FROM files",
)
def _(c: Collection):
    return K.classify_inputs(files(c)).select("id", "path", "kind")


@query(
    "input_errors",
    with_sql("counts", extra={"files": _FILES_SQL, "counts": f"""
      SELECT scene, count(*) FILTER (kind = 'orthophoto') AS images, count(*) FILTER (kind LIKE '%cloud') AS clouds,
       count(*) FILTER (kind = 'dem' AND role IS NULL) AS terrains, count(role) AS aboves
      FROM (SELECT *, {_KIND} AS kind FROM files) GROUP BY scene"""})
    + """SELECT scene, 'several orthophotos' AS error FROM counts WHERE images > 1
      UNION ALL SELECT scene, 'nothing to load' FROM counts WHERE clouds = 0 AND terrains = 0
      UNION ALL SELECT scene, 'height model without terrain' FROM counts WHERE aboves > 0 AND terrains = 0""",
)
def _(c: Collection):
    return K.input_errors(K.classify_inputs(files(c)), ["scene"])


@query(
    "corner_to_centre",
    with_sql("squares")
    + f"""SELECT raster_id, {q('2e0')} AS a, {q('0.25e0')} AS b, {q('x0 + 2e0/2 + 0.25e0/2')} AS c, {q('0.5e0')} AS d,
      {q('-2e0')} AS e, {q('y0 + 0.5e0/2 + -2e0/2')} AS f, true AS has_geo FROM squares""",
)
def _(c: Collection):
    gt = [F.col("x0"), F.lit(2.0), F.lit(0.25), F.col("y0"), F.lit(0.5), F.lit(-2.0)]
    affine = frame.corner_to_centre(gt)
    return c.squares.select("raster_id", *fixed_as(**affine), frame.has_georeference(gt).alias("has_geo"))


@query(
    "rescale_affine",
    with_sql("squares")
    + f"""SELECT raster_id, {q('2e0*sx')} AS a, {q('x0 + 2e0*sx/2')} AS c, {q('-2e0*sy')} AS e,
      {q('y0 + -2e0*sy/2')} AS f FROM (SELECT *, CAST(100 + raster_id AS DOUBLE)/50e0 AS sx,
      CAST(80 + raster_id AS DOUBLE)/40e0 AS sy FROM squares)""",
)
def _(c: Collection):
    zero = F.lit(0.0)
    gt = [F.col("x0"), F.lit(2.0), zero, F.col("y0"), zero, F.lit(-2.0)]
    affine = frame.rescale_affine(gt, F.col("raster_id") + 100, F.col("raster_id") + 80, 50, 40)
    return c.squares.select("raster_id", *fixed_as(**{k: affine[k] for k in "acef"}))


@query(
    "valid_format",
    """SELECT l_suppkey AS id, l_orderkey, l_linenumber, l_partkey,
      (l_orderkey % 12) <= 10 AND 18 + l_partkey % 60 >= coalesce(
        [20,28,26,34,57,63,30,36,38,59,67][l_orderkey % 12 + 1], 1000) AS ok
      FROM lineitem""",
)
def _(c: Collection):
    # The upper two bits of the format byte mark compression and are ignored.
    coded = (F.col("l_orderkey") % 12 + (F.col("l_partkey") % 4) * 64).cast("int")
    length = (F.col("l_partkey") % 60 + 18).cast("int")
    return c.table("lineitem").select(
        F.col("l_suppkey").alias("id"), "l_orderkey", "l_linenumber", "l_partkey",
        rules.valid_format(coded, length).alias("ok"),
    )


@query(
    "node_intersects",
    with_sql("bounds")
    + """SELECT DISTINCT file_id, depth, nx, ny FROM (
      SELECT *, minx + nx*s AS x0, miny + ny*s AS y0 FROM (
       SELECT b.file_id, p.depth, CAST(floor((p.x - b.minx)/(256e0/pow(2e0, p.depth))) AS INTEGER) AS nx,
        CAST(floor((p.y - b.miny)/(256e0/pow(2e0, p.depth))) AS INTEGER) AS ny, b.minx, b.miny,
        256e0/pow(2e0, p.depth) AS s
       FROM (SELECT *, CAST(file_idx % 5 AS INTEGER) AS depth FROM pts) p JOIN bounds b USING (file_id)))
      WHERE x0 <= minx + 120e0 AND x0 + s >= minx + 60e0 AND y0 <= miny + 90e0 AND y0 + s >= miny + 30e0""",
)
def _(c: Collection):
    corner = c.bounds.select("file_id", F.struct("minx", "miny", F.lit(256.0).alias("side")).alias("root"))
    side = F.lit(256.0) / F.pow(F.lit(2.0), F.col("depth").cast("double"))
    nodes = (
        c.points.withColumn("depth", (F.col("file_idx") % 5).cast("int"))
        .transform(lambda df: join_catalog(df, corner, "file_id", ["file_idx"]))
        .select(
            "file_id",
            "depth",
            F.floor((F.col("x") - F.col("root.minx")) / side).cast("int").alias("nx"),
            F.floor((F.col("y") - F.col("root.miny")) / side).cast("int").alias("ny"),
            "root",
        )
        .distinct()
        .withColumn("node_box", rules.node_box("depth", "nx", "ny", F.col("root")))
    )
    x, y = F.col("root.minx"), F.col("root.miny")
    wanted = box(x + 60.0, y + 30.0, x + 120.0, y + 90.0)
    return K.nodes_for_box(nodes, wanted).select("file_id", "depth", "nx", "ny")


@query(
    "level_for_span",
    f"""SELECT o_orderkey, CAST({clamp("ceil(log2(((o_orderkey*7 + 2)/8e0)/64e0))", "0", "20")} AS INTEGER) AS level
      FROM orders""",
)
def _(c: Collection):
    size = (F.col("o_orderkey") * 7 + 2) / 8.0
    return c.table("orders").select(
        "o_orderkey", rules.level_for_span(size, size / 2, 64.0).alias("level")
    )


_WGS_BOXES = "SELECT raster_id AS id, 2e0 + x0/5000e0 AS minx, 45e0 + y0/5000e0 AS miny, 2.05e0 + x0/5000e0 AS maxx, 45.04e0 + y0/5000e0 AS maxy FROM squares"


def _geographic_boxes(c: Collection) -> DataFrame:
    x, y = F.col("x0") / 5000.0, F.col("y0") / 5000.0
    return c.squares.select(
        F.col("raster_id").alias("id"),
        (x + 2.0).alias("minx"),
        (y + 45.0).alias("miny"),
        (x + 2.05).alias("maxx"),
        (y + 45.04).alias("maxy"),
    )


def _edge_sql() -> str:
    from terraframe.plans.point_queries import _CONE, _project_sql

    px, py = _project_sql("x", "y", _CONE, (3, 700000, 6600000))

    def mm(e: str) -> str:
        return f"CAST(floor(({e})*1e3 + 0.5e0) AS BIGINT)"

    edges = {
        "wgs": _WGS_BOXES,
        "samples": """SELECT id, minx + i/20e0*(maxx-minx) AS x, miny AS y FROM wgs, range(21) r(i)
           UNION ALL SELECT id, minx + i/20e0*(maxx-minx), maxy FROM wgs, range(21) r(i)
           UNION ALL SELECT id, minx, miny + i/20e0*(maxy-miny) FROM wgs, range(21) r(i)
           UNION ALL SELECT id, maxx, miny + i/20e0*(maxy-miny) FROM wgs, range(21) r(i)""",
    }
    return (
        with_sql("samples", extra=edges)
        + f"""SELECT id, {mm(f'min({px})')} AS minx, {mm(f'min({py})')} AS miny, {mm(f'max({px})')} AS maxx,
          {mm(f'max({py})')} AS maxy FROM samples GROUP BY id"""
    )


@query("edge_extent", _edge_sql())
def _(c: Collection):
    moved = K.edge_extent(_geographic_boxes(c), 4171, 2154)
    mm = [F.floor(F.col(k) * 1e3 + 0.5).alias(k) for k in ("minx", "miny", "maxx", "maxy")]
    return moved.select("id", *mm)


@query(
    "same_crs_in_practice",
    with_sql("inputs", extra={"inputs": _INPUTS_SQL})
    + f"""SELECT ord AS id, 'lambert' AS compared, {_SAME} = 2154 AS same FROM inputs
      UNION ALL SELECT ord, 'cone', {_SAME} = 1 FROM inputs""",
)
def _(c: Collection):
    """Each input's CRS against two others, over its own extent; degrees are never metres, what is not understood is nothing."""
    declared = inputs(c).select(F.col("ord").alias("id"), "wkt", "box.*")
    own = crs_parameters("wkt")
    out = [
        K.same_crs_in_practice(declared, own, crs_parameters(F.lit(text))).select("id", F.lit(name).alias("compared"), "same")
        for name, text in (("lambert", "EPSG:2154"), ("cone", CONE_PROJ))
    ]
    return out[0].unionByName(out[1])
