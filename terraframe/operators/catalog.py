"""Operators on catalogs: one row per file or raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions.crs import horizontal_epsg, reproject
from terraframe.functions.crs_columns import DEGREES, METRES, moved_over, same_crs
from terraframe.functions.rules import boxes_meet
from terraframe.operators.boxes import overlap_area, overlap_join

# Coverage an image needs to colour a cloud; samples along an
# edge of an extent that is transformed.
MIN_COVERAGE = 0.25
EDGE_SAMPLES = 21


def union_bounds(catalogs: list[DataFrame]) -> DataFrame:
    """All inputs as one set; catalogs without heights get null z."""
    result = catalogs[0]
    for other in catalogs[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def scene_frame(catalog: DataFrame) -> DataFrame:
    """One row: centre, diagonal and elevation range of all inputs.

    ``catalog`` has minx..maxy and nullable minz, maxz; above-ground inputs
    must be left out by the caller.
    """
    box = catalog.agg(
        *(F.min(f"min{c}").alias(f"min{c}") for c in "xyz"),
        *(F.max(f"max{c}").alias(f"max{c}") for c in "xyz"),
    )
    low, high = F.coalesce("minz", F.lit(0.0)), F.coalesce("maxz", F.lit(0.0))
    dx, dy, dz = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), high - low
    diagonal = F.sqrt(dx * dx + dy * dy + dz * dz)
    return box.select(
        ((F.col("minx") + F.col("maxx")) * 0.5).alias("cx"),
        ((F.col("miny") + F.col("maxy")) * 0.5).alias("cy"),
        ((low + high) * 0.5).alias("cz"),
        F.when(diagonal < 1e-9, 1.0).otherwise(diagonal).alias("scale"),
        low.alias("zmin"),
        F.when(dz > 1e-9, high).otherwise(low + 1.0).alias("zmax"),
    )


def as_scalar(one_row: DataFrame) -> Column:
    """A one-row DataFrame as a struct column: a scalar subquery, not a join."""
    return one_row.select(F.struct(*one_row.columns)).scalar()


def scene_crs(catalog: DataFrame) -> DataFrame:
    """First declared CRS: clouds, then terrain rasters, then the image, in input order."""
    rank = (
        F.when(F.col("kind") == "cloud", 0).when(F.col("kind") == "dem", 1).otherwise(2)
    )
    declared = F.col("wkt").isNotNull() & (F.col("wkt") != "")
    return (
        catalog.where(declared)
        .agg(F.min_by("wkt", F.struct(rank, F.col("ord"))).alias("wkt"))
        .withColumn("epsg", horizontal_epsg("wkt"))
    )


def is_declared(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) != ""


def crs_mismatch(catalog: DataFrame, scene: Column) -> DataFrame:
    """Inputs in another horizontal CRS than ``scene`` (``wkt``): clouds flagged, rasters to be warped.

    catalog: ``kind``, ``wkt`` and ``box``, the input's extent in its own
    CRS. CRSs that are the same in practice over that extent do not differ.
    """
    named = catalog.withColumn("__scene", scene["wkt"]).withColumn("epsg", horizontal_epsg("wkt"))
    return named.withColumn(
        "action",
        F.when(~is_declared(F.col("wkt")) | same_crs("wkt", "__scene", F.col("box")), "none")
        .when(F.col("kind") == "cloud", "misplaced")
        .otherwise("warp"),
    ).drop("__scene")


def classify_inputs(files: DataFrame) -> DataFrame:
    """Kind of each input file (path, bands, dtype)."""
    name = F.lower("path")
    tif = name.rlike(r"\.tiff?$")
    image = tif & (F.col("bands") >= 3) & (F.col("dtype") == "byte")
    return files.withColumn(
        "kind",
        F.when(image, "orthophoto")
        .when(tif, "dem")
        .when(F.col("path").contains(".copc."), "tiled_cloud")
        .otherwise("cloud"),
    )


def input_errors(classified: DataFrame, scene: list[str] | None = None) -> DataFrame:
    """Reasons a set of inputs cannot be loaded; no rows when it can.

    ``classified`` has kind, and role 'height' or 'surface' on above-ground
    rasters (null elsewhere). ``scene`` are the columns naming one set.
    """
    keys = scene or []
    above = F.col("role").isin("height", "surface")
    counts = classified.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "orthophoto").alias("images"),
        F.count_if(F.col("kind").isin("cloud", "tiled_cloud")).alias("clouds"),
        F.count_if((F.col("kind") == "dem") & ~F.coalesce(above, F.lit(False))).alias("terrains"),
        F.count_if(F.coalesce(above, F.lit(False))).alias("aboves"),
    )
    problems = F.filter(
        F.array(
            F.when(F.col("images") > 1, F.lit("several orthophotos")),
            F.when((F.col("clouds") == 0) & (F.col("terrains") == 0), F.lit("nothing to load")),
            F.when((F.col("aboves") > 0) & (F.col("terrains") == 0), F.lit("height model without terrain")),
        ),
        lambda e: e.isNotNull(),
    )
    return counts.select(*keys, F.explode(problems).alias("error"))


def pair_ground(above: DataFrame, ground: DataFrame) -> DataFrame:
    """Each above-ground raster with the terrain it overlaps most.

    ``above`` has above_id and above_box, ``ground`` ground_id, ground_box and
    ord (load order, breaks ties). No overlap: null ground.
    """
    area = overlap_area(F.col("above_box"), F.col("ground_box"))
    best = (
        overlap_join(above, ground, "above_box", "ground_box")
        .withColumn("area", area)
        .where(F.col("area") > 0)
        .groupBy("above_id")
        .agg(
            F.max_by(
                F.struct("ground_id", "area"), F.struct(F.col("area"), -F.col("ord"))
            ).alias("best")
        )
    )
    return (
        above.select("above_id")
        .join(best, "above_id", "left")
        .select("above_id", F.col("best.ground_id").alias("ground_id"), F.col("best.area").alias("area"))
    )


def image_coverage(clouds: DataFrame, images: DataFrame) -> DataFrame:
    """Covered share of each cloud's plan extent by each image it meets.

    ``clouds``: file_id, cloud_box, cloud_crs; ``images``: image_id,
    image_box (null: not georeferenced), image_crs (texts). An image colours a
    cloud when it covers a quarter of it in the same CRS, by declaration or
    in practice over the cloud; a cloud that declares none is taken to be in the image's.
    """
    b = F.col("cloud_box")
    area = (b["maxx"] - b["minx"]) * (b["maxy"] - b["miny"])
    covered = overlap_area(b, F.col("image_box"))
    pairs = overlap_join(clouds, images.where(F.col("image_box").isNotNull()), "cloud_box", "image_box")
    same = ~is_declared(F.col("cloud_crs")) | same_crs("cloud_crs", "image_crs", b)
    return pairs.select(
        "file_id",
        "image_id",
        F.when(area > 0, covered / F.when(area > 0, area)).otherwise(0.0).alias("coverage"),
        same.alias("same_crs"),
    ).withColumn("colours", F.col("same_crs") & (F.col("coverage") >= MIN_COVERAGE))


def image_overlap(rasters: DataFrame, images: DataFrame) -> DataFrame:
    """For each terrain raster: 'image' if one overlaps it, 'ramp' if none does.

    ``rasters``: raster_id, raster_box; ``images``: image_id, image_box.
    Touching boxes do not overlap.
    """
    hits = (
        overlap_join(rasters, images, "raster_box", "image_box")
        .where(overlap_area(F.col("raster_box"), F.col("image_box")) > 0)
        .groupBy("raster_id")
        .agg(F.count(F.lit(1)).alias("images"))
    )
    return (
        rasters.select("raster_id")
        .join(hits, "raster_id", "left")
        .select(
            "raster_id",
            F.coalesce("images", F.lit(0)).alias("images"),
            F.when(F.col("images") > 0, "image").otherwise("ramp").alias("colour_source"),
        )
    )


def edge_extent(boxes: DataFrame, source, target) -> DataFrame:
    """Extent of each box (id, minx..maxy) in another CRS, from 21 samples an edge."""
    t = F.col("i") / F.lit(float(EDGE_SAMPLES - 1))
    along_x = F.col("minx") + t * (F.col("maxx") - F.col("minx"))
    along_y = F.col("miny") + t * (F.col("maxy") - F.col("miny"))
    samples = F.array(
        F.struct(along_x.alias("x"), F.col("miny").alias("y")),
        F.struct(along_x.alias("x"), F.col("maxy").alias("y")),
        F.struct(F.col("minx").alias("x"), along_y.alias("y")),
        F.struct(F.col("maxx").alias("x"), along_y.alias("y")),
    )
    spread = (
        boxes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(EDGE_SAMPLES - 1))))
        .withColumn("p", F.explode(samples))
        .select("id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    )
    nx, ny = reproject("x", "y", source, target)
    return spread.groupBy("id").agg(
        F.min(nx).alias("minx"), F.min(ny).alias("miny"), F.max(nx).alias("maxx"), F.max(ny).alias("maxy")
    )


def same_crs_in_practice(boxes: DataFrame, source: Column, target: Column) -> DataFrame:
    """Whether two CRSs place a 5 x 5 grid over each box (id, minx..maxy) within 1 mm (1e-8 degrees).

    source, target: parameters of each row's CRSs, as ``crs_parameters`` or
    ``known_parameters`` give them. CRSs of different kinds (geographic,
    projected) are never the same: ``moved`` is null.
    """
    box = F.struct("minx", "miny", "maxx", "maxy")
    limit = F.when(target["geographic"], F.lit(DEGREES)).otherwise(F.lit(METRES))
    moved = boxes.select("id", moved_over(box, source, target).alias("moved"), limit.alias("__limit"))
    return moved.select("id", "moved", F.coalesce(F.col("moved") <= F.col("__limit"), F.lit(False)).alias("same"))


def nodes_for_box(nodes: DataFrame, query: Column) -> DataFrame:
    """Octree nodes whose footprint meets a query box."""
    return nodes.where(boxes_meet(F.col("node_box"), query))
