"""Root blocks: the pixels of one root cell of a quadtree, packed into arrays with a halo.

A root is a cell of the first level that may keep a cell, so a block is at
most about ``max_span`` pixels a side whatever the size of the raster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions.rules import level_for_span
from terraframe.operators.blocks import pack
from terraframe.operators.lookup import sized
from terraframe.session import spread

# Root cells per side, widest leaf in pixels, tolerance angle
# in degrees, deepest level unless the span asks for more.
COARSE, MAX_SPAN, ANGLE, MAX_LEVEL = 8, 64.0, 1.0, 5

ROOT = ["raster_id", "rx", "ry"]
_GEOMETRY = ["width", "height", "pw", "ph", "cw0", "ch0", "root_level"]


def tree_geometry(
    catalog: DataFrame, coarse: int = COARSE, max_level: int = MAX_LEVEL, max_span: float = MAX_SPAN, carried: tuple[str, ...] = ()
) -> DataFrame:
    """Per raster: level-0 cell size, first level within the span, deepest level; ``carried`` columns stay."""
    sized = catalog.select(
        "raster_id",
        *carried,
        "width",
        "height",
        F.abs("a").alias("pw"),
        F.abs("e").alias("ph"),
        ((F.col("width") - 1) / float(coarse)).alias("cw0"),
        ((F.col("height") - 1) / float(coarse)).alias("ch0"),
    )
    return sized.withColumn("root_level", level_for_span("cw0", "ch0", max_span)).withColumn(
        "max_level", F.greatest(F.col("root_level"), F.lit(max_level))
    )


def deepest_level(
    catalog: DataFrame, coarse: int = COARSE, max_level: int = MAX_LEVEL, max_span: float = MAX_SPAN
) -> int:
    """The deepest level of any raster: the lattice on which leaves of all of them are compared.

    A raster too large for ``max_level`` starts deeper than that; what works
    on leaves takes this number instead (an aggregate of the catalog).
    """
    found = tree_geometry(catalog, coarse, max_level, max_span).agg(F.max("max_level")).first()[0]
    return max_level if found is None else int(found)


def _near(index: str, cell0: str) -> str:
    """Root cells (one axis) whose block holds a pixel: floor(lo) .. floor(hi)+1."""
    size = f"({cell0} / __parts)"
    first = f"greatest(cast(floor(({index} - 1) / {size}) AS int) - 1, 0)"
    last = f"least(cast(floor(({index} + 1) / {size}) AS int), __roots - 1)"
    return (
        f"explode(filter(sequence(least({first}, {last}), {last}), k ->"
        f" k >= 0 AND floor(k * {size}) <= {index} AND {index} <= floor(k * {size} + {size}) + 1))"
    )


def _root_geometry(catalog: DataFrame, coarse: int, max_span: float, carried: tuple[str, ...] = ()) -> DataFrame:
    parts = "pow(2D, cast(root_level AS double))"
    found = tree_geometry(catalog, coarse, 0, max_span, carried)
    return found.selectExpr("raster_id", *carried, *_GEOMETRY, f"{parts} AS __parts", f"cast({coarse} * {parts} AS int) AS __roots")


def root_blocks(pixels: DataFrame, catalog: DataFrame, coarse: int = COARSE, max_span: float = MAX_SPAN) -> DataFrame:
    """Pixels (v, filled) packed into one block per root cell, with the raster's geometry and ``roots`` per side.

    The one shuffle of a raster. Only what places a pixel travels with it;
    the geometry is attached to the blocks.
    """
    geometry = sized(_root_geometry(catalog, coarse, max_span))
    placed = (
        pixels.select("raster_id", "row", "col", "v", "filled")
        .join(geometry.select("raster_id", "cw0", "ch0", "__parts", "__roots"), "raster_id")
        .selectExpr("raster_id", "row", "col", "v", "filled", f"{_near('col', 'cw0')} AS rx", "ch0", "__parts", "__roots")
        .selectExpr("raster_id", "row", "col", "v", "filled", "rx", f"{_near('row', 'ch0')} AS ry")
    )
    blocks = pack(placed, ROOT, ["v", "filled"])
    whole = blocks.join(geometry, "raster_id").withColumnRenamed("__roots", "roots")
    return whole.select(*ROOT, "row0", "col0", "bw", "bh", "v", "filled", *_GEOMETRY, "roots")


def whole_rasters(pixels: DataFrame, values: list[str], catalog: DataFrame) -> DataFrame:
    """``catalog`` with each raster's values as row-major arrays: for rasters that one task may take whole (``fit_whole``).

    One shuffle of the pixels as they are; what multiplies them comes behind it, on arrays.
    """
    packed = pack(spread(pixels.select("raster_id", "row", "col", *values), "raster_id"), ["raster_id"], values)
    return packed.select("raster_id", *values).join(sized(catalog), "raster_id")


def root_blocks_of_rasters(rasters: DataFrame, coarse: int = COARSE, max_span: float = MAX_SPAN) -> DataFrame:
    """As ``root_blocks``, cut out of whole rasters: catalog rows with ``v`` and ``filled`` as row-major arrays.

    Bands of lines are sliced first, blocks out of these. No pixel is a row of its own, and nothing is shuffled.
    """

    def ends(index: str, cell0: str, count: str) -> tuple[str, str]:
        """First and last pixel of root ``index`` along one axis, halo included."""
        size = f"({cell0} / __parts)"
        return f"cast(floor({index} * {size}) AS int)", f"least(cast(floor({index} * {size} + {size}) AS int) + 1, {count} - 1)"

    geometry = _root_geometry(rasters, coarse, max_span, ("v", "filled")).withColumnRenamed("__roots", "roots")
    dense = "CASE WHEN size(v) = width * height THEN {0} ELSE cast(raise_error('a raster is not as its catalog says') AS int) END"
    (top, bottom), (left, right) = ends("ry", "ch0", "height"), ends("rx", "cw0", "width")
    band = "slice({0}, row0 * width + 1, bh * width) AS {0}"
    bands = (
        geometry.selectExpr("*", "explode(sequence(0, roots - 1)) AS ry")
        .selectExpr("*", f"{dense.format(top)} AS row0", f"{bottom} AS __last")
        .selectExpr("*", "__last - row0 + 1 AS bh")
        .selectExpr("raster_id", *_GEOMETRY, "__parts", "roots", "ry", "row0", "bh", band.format("v"), band.format("filled"))
    )
    block = "flatten(transform(sequence(0, bh - 1), r -> slice({0}, r * width + col0 + 1, bw))) AS {0}"
    blocks = (
        bands.selectExpr("*", "explode(sequence(0, roots - 1)) AS rx")
        .selectExpr("*", f"{left} AS col0", f"{right} AS __end")
        .selectExpr("*", "__end - col0 + 1 AS bw")
    )
    return blocks.selectExpr(*ROOT, "row0", "col0", "bw", "bh", block.format("v"), block.format("filled"), *_GEOMETRY, "roots")
