"""Adaptive terrain quadtrees as tables: (raster_id, level, ix, iy).

A level-L cell covers pixels ``ix*cw .. (ix+1)*cw`` with
``cw = (width-1) / (coarse * 2^L)``. Cells may only stay whole once they span
at most ``max_span`` pixels, so nothing is decided above the first level that
is that fine. One cell of that level (a *root* here) is at most about
``max_span`` pixels a side: pixels are packed once into root blocks
(:mod:`terraframe.operators.roots`), and everything below a root is worked
out where its block is. A raster of any size is many small roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions.frame import (
    geo_struct,
    image_uv,
    pixel_to_world,
    texel_uv,
    to_scene,
)
from terraframe.operators import descent
from terraframe.operators.blocks import BLOCK, to_blocks
from terraframe.operators.lookup import join_catalog
from terraframe.operators.roots import (  # noqa: F401
    ANGLE,
    COARSE,
    MAX_LEVEL,
    MAX_SPAN,
    deepest_level,
    root_blocks,
    root_blocks_of_rasters,
    tree_geometry,
    whole_rasters,
)
from terraframe.operators.sampling import sample_filled
from terraframe.session import stored

CELL = ["raster_id", "level", "ix", "iy"]
#: Levels whose leaves are gathered in one row for ``leaf_at``: at most 16 leaves a row.
GATHERED = 2


def within_lattice(leaves: DataFrame, max_level: int) -> DataFrame:
    """``leaves`` as they are; a leaf below ``max_level`` is an error, since nothing could be said about it."""
    deep = F.raise_error(F.concat(F.lit(f"a leaf is below max_level {max_level}: level "), F.col("level").cast("string")))
    return leaves.withColumn("level", F.when(F.col("level") <= max_level, F.col("level")).otherwise(deep.cast("int")))


def cell_stats(
    pixels: DataFrame,
    catalog: DataFrame,
    coarse: int = COARSE,
    max_level: int = MAX_LEVEL,
    max_span: float = MAX_SPAN,
) -> DataFrame:
    """Deviation and unknown samples of every cell from the root level down.

    ``pixels`` has v and filled. ``deviation`` is the largest distance of a
    known pixel from the bilinear patch through the cell's corners, borders
    included; ``unknown`` counts the unknown among corners and centre;
    ``centre_unknown`` is the centre alone. Worked out inside each root block.
    """
    return descent.cell_stats(root_blocks(pixels, catalog, coarse, max_span), max_level)


def _sampled_unknown(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """Unknown samples of cells by equi-join on the five nearest pixels of each."""

    def sample(share_x: str, share_y: str, centre: str) -> str:
        c = f"least(floor(ix * cw + cw * {share_x} + 0.5D), width - 1)"
        r = f"least(floor(iy * ch + ch * {share_y} + 0.5D), height - 1)"
        return f"struct(cast({c} AS int) AS col, cast({r} AS int) AS row, {centre} AS centre)"

    five = [sample(x, y, "false") for x in ("0", "1") for y in ("0", "1")]
    five.append(sample("0.5D", "0.5D", "true"))
    probes = (
        cells.selectExpr("*", "pow(2D, cast(level AS double)) AS __n")
        .selectExpr("*", "cw0 / __n AS cw", "ch0 / __n AS ch")
        .selectExpr(*CELL, f"explode(array({', '.join(five)})) AS p")
        .selectExpr(*CELL, "p.*")
    )
    unknown = pixels.where("v IS NULL").selectExpr("raster_id", "row", "col", "1 AS gap")
    return (
        probes.join(unknown, ["raster_id", "row", "col"], "left")
        .groupBy(*CELL)
        .agg(
            F.expr("cast(count(gap) AS int)").alias("unknown"),
            F.expr("cast(coalesce(max(CASE WHEN centre THEN gap END), 0) AS int)").alias(
                "centre_unknown"
            ),
        )
    )


def quadtree_leaves(
    pixels: DataFrame,
    catalog: DataFrame,
    coarse: int = COARSE,
    max_level: int = MAX_LEVEL,
    angle: float = ANGLE,
    max_span: float = MAX_SPAN,
) -> DataFrame:
    """Leaves of the error-bounded quadtree of each raster.

    A cell stays whole when none of its samples is unknown, it spans at most
    ``max_span`` pixels and its deviation is within the tolerance angle. It
    is dropped when all samples are unknown, and at the deepest level when
    its centre is. The rasters are packed into root blocks and judged there
    (:mod:`terraframe.operators.descent`); with a stored block table call
    ``leaves_of_blocks`` instead, which reads no pixel table.
    """
    return descent.leaves_of_blocks(root_blocks(pixels, catalog, coarse, max_span), max_level, angle, max_span)


def leaf_at(probes: DataFrame, leaves: DataFrame, keys: list[str], max_level: int) -> DataFrame:
    """Level of the leaf covering finest-lattice cell (fx, fy) of each probe.

    Adds ``found``: null outside the lattice or where nothing is left. Leaves
    of the last levels (``GATHERED``) lie in one row for each of their cells of the level
    above those, at most 4^GATHERED a row; a probe looks into the row of its own
    cell, and tries its coarser ancestors by equi-join where there are such
    leaves; at most one can be a leaf. Two looks at the leaves: store them.
    """
    leaves = within_lattice(leaves.select(*CELL), max_level)
    top = leaves.agg(F.min("level")).first()[0]
    base = max(max_level - GATHERED, 0)
    base = base if top is None else max(base, min(top, max_level))
    top = base if top is None else min(top, base)
    up = f"greatest(level - {base}, 0)"
    cells = (
        leaves.selectExpr("raster_id", f"least(level, {base}) AS __l", f"shiftright(ix, {up}) AS __x", f"shiftright(iy, {up}) AS __y", "struct(level, ix, iy) AS c")
        .groupBy("raster_id", "__l", "__x", "__y")
        .agg(F.collect_list("c").alias("__cells"))
    )
    covers = f"c -> c.ix = shiftright(fx, {max_level} - c.level) AND c.iy = shiftright(fy, {max_level} - c.level)"
    found = f"get(filter(__cells, {covers}), 0).level AS found"
    at = ["raster_id", "__l", "__x", "__y"]

    def of_level(df: DataFrame) -> DataFrame:
        return df.withColumns({f"__{k}": F.expr(f"shiftright(f{k}, {max_level} - __l)") for k in "xy"})

    if top == base:
        return of_level(probes.withColumn("__l", F.lit(base))).join(cells, at, "left").selectExpr(*probes.columns, found)
    tried = of_level(probes.where("fx >= 0 AND fy >= 0").withColumn("__l", F.explode(F.sequence(F.lit(top), F.lit(base)))))
    hits = tried.join(cells, at).selectExpr(*keys, found).where("found IS NOT NULL")
    return probes.join(hits, keys, "left")


def _span(max_level: int) -> Column:
    return F.expr(f"shiftleft(1, {max_level} - level)")


def neighbour_levels(leaves: DataFrame, max_level: int) -> DataFrame:
    """Level of the leaf beside the middle of each of a leaf's four edges.

    Sides: 0 row-, 1 col+, 2 row+, 3 col-. ``neighbour`` is null at the
    raster's edge and beside dropped cells.
    """
    s = F.col("__s")
    x0, y0, mid = F.col("ix") * s, F.col("iy") * s, F.expr("shiftright(__s, 1)")
    sides = F.array(
        *(
            F.struct(F.lit(k).alias("side"), x.cast("int").alias("fx"), y.cast("int").alias("fy"))
            for k, (x, y) in enumerate(
                ((x0 + mid, y0 - 1), (x0 + s, y0 + mid), (x0 + mid, y0 + s), (x0 - 1, y0 + mid))
            )
        )
    )
    probes = (
        within_lattice(leaves.select(*CELL), max_level)
        .withColumn("__s", _span(max_level))
        .select(*(F.col(k).alias(f"leaf_{k}") if k != "raster_id" else F.col(k) for k in CELL),
                F.explode(sides).alias("p"))
        .select("raster_id", "leaf_level", "leaf_ix", "leaf_iy", "p.*")
    )
    keys = ["raster_id", "leaf_level", "leaf_ix", "leaf_iy", "side"]
    found = leaf_at(probes, leaves, keys, max_level)
    return found.select(
        "raster_id",
        F.col("leaf_level").alias("level"),
        F.col("leaf_ix").alias("ix"),
        F.col("leaf_iy").alias("iy"),
        "side",
        F.col("found").alias("neighbour"),
    )


def balance_leaves(leaves: DataFrame, max_level: int) -> DataFrame:
    """Split leaves until edge neighbours are at most one level apart.

    Works from the finest level up, once: a level-L leaf needs, beside its
    parent, cells of level L-1 at least. Any coarser leaf there is split down
    to that cell, and the new leaves take part in the later, coarser steps.
    Every split is one that any balanced refinement must make, so the result
    is the same as repeating simultaneous passes until nothing changes. Only
    what a step breaks is written; a step that breaks nothing costs one look.
    """
    current = stored(within_lattice(leaves.select(*CELL), max_level))
    top = current.agg(F.min("level")).first()[0]
    # beside a parent there is nothing to split unless a leaf may be coarser than it
    for level in range(max_level, max_level if top is None else top + 1, -1):
        broken = stored(_broken(current, level))
        if not broken.isEmpty():
            current = stored(current.unionByName(children(broken)).join(broken, CELL, "left_anti"))
    return current


def _broken(leaves: DataFrame, level: int) -> DataFrame:
    """Cells that stop being leaves so that there is room beside the leaves of one level."""
    fine = leaves.where(F.col("level") == level)
    px, py = F.expr("shiftright(ix, 1)"), F.expr("shiftright(iy, 1)")
    # Only the outer sides: the inner neighbours are siblings.
    dx, dy = F.col("ix") % 2 * 2 - 1, F.col("iy") % 2 * 2 - 1
    wanted = (
        fine.select(
            "raster_id",
            F.explode(
                F.array(
                    F.struct((px + dx).cast("int").alias("wx"), py.alias("wy")),
                    F.struct(px.alias("wx"), (py + dy).cast("int").alias("wy")),
                )
            ).alias("w"),
        )
        .select("raster_id", "w.*")
        .where((F.col("wx") >= 0) & (F.col("wy") >= 0))
        .distinct()
    )
    wl = level - 1
    covering = (
        wanted.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(wl - 1))))
        .withColumn("ix", F.expr(f"shiftright(wx, {wl} - level)"))
        .withColumn("iy", F.expr(f"shiftright(wy, {wl} - level)"))
        .join(leaves, CELL, "left_semi")
    )
    # From the covering leaf down to the parent of the wanted cell; their
    # children that are not among them are leaves.
    return (
        covering.withColumn("k", F.explode(F.sequence(F.col("level"), F.lit(wl - 1))))
        .select(
            "raster_id",
            F.col("k").alias("level"),
            F.expr(f"shiftright(wx, {wl} - k)").alias("ix"),
            F.expr(f"shiftright(wy, {wl} - k)").alias("iy"),
        )
        .distinct()
    )


def children(cells: DataFrame) -> DataFrame:
    """The four half-size cells of each cell."""
    quarter = F.array(
        *(F.struct(F.lit(k & 1).alias("qx"), F.lit(k >> 1).alias("qy")) for k in range(4))
    )
    return (
        cells.withColumn("q", F.explode(quarter))
        .select(
            "raster_id",
            (F.col("level") + 1).cast("int").alias("level"),
            (F.col("ix") * 2 + F.col("q.qx")).cast("int").alias("ix"),
            (F.col("iy") * 2 + F.col("q.qy")).cast("int").alias("iy"),
        )
    )


def drop_unknown_leaves(
    leaves: DataFrame, pixels: DataFrame, catalog: DataFrame, coarse: int = COARSE
) -> DataFrame:
    """Leaves left after balancing whose centre or all five samples are unknown go."""
    size = catalog.select(
        "raster_id",
        "width",
        "height",
        ((F.col("width") - 1) / float(coarse)).alias("cw0"),
        ((F.col("height") - 1) / float(coarse)).alias("ch0"),
    )
    sampled = _sampled_unknown(join_catalog(leaves.select(*CELL), size, "raster_id", ["ix", "iy"]), pixels)
    gone = (F.col("unknown") == 5) | ((F.col("unknown") > 0) & (F.col("centre_unknown") == 1))
    return sampled.where(~gone).select(*CELL)


def cell_nodata(
    cells: DataFrame, pixels: DataFrame, catalog: DataFrame, coarse: int = COARSE
) -> DataFrame:
    """Unknown samples (0..5) of any cells."""
    size = catalog.select(
        "raster_id",
        "width",
        "height",
        ((F.col("width") - 1) / float(coarse)).alias("cw0"),
        ((F.col("height") - 1) / float(coarse)).alias("ch0"),
    )
    return _sampled_unknown(join_catalog(cells.select(*CELL), size, "raster_id", ["ix", "iy"]), pixels)


def level_histogram(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("raster_id", "level").agg(F.count(F.lit(1)).alias("leaves"))


def corner_lattice(max_level: int) -> list[tuple[Column, Column]]:
    """Finest-lattice corners of a leaf, in patch order."""
    s = _span(max_level)
    x, y = F.col("ix") * s, F.col("iy") * s
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def edge_codes(leaves: DataFrame, max_level: int) -> DataFrame:
    """How each edge meets its neighbour: one row per leaf and side.

    0 same size or none; 2 this is the coarse side; 1 or 3 the fine side,
    the coarse edge starting at this edge's start (1) or ending at its end
    (3). ``far_x``, ``far_y``: the coarse edge's other end on the finest
    lattice, for fine sides.
    """
    sided = neighbour_levels(leaves, max_level).withColumn("__s", _span(max_level))
    s = F.col("__s")
    own_x, own_y = F.col("ix") * s, F.col("iy") * s
    par_x, par_y = F.expr("shiftright(ix, 1)") * s * 2, F.expr("shiftright(iy, 1)") * s * 2
    # Corner k of a cell of size u at (x, y); the edge of side k runs from
    # corner k to corner k + 1.
    shift = ((0, 0), (1, 0), (1, 1), (0, 1))

    def corner(x: Column, y: Column, u: Column, k: int) -> Column:
        dx, dy = shift[k % 4]
        return F.struct((x + u * dx).cast("int").alias("x"), (y + u * dy).cast("int").alias("y"))

    def by_side(make) -> Column:
        value = None
        for k in range(4):
            value = (
                F.when(F.col("side") == k, make(k))
                if value is None
                else value.when(F.col("side") == k, make(k))
            )
        return value

    ends = (
        sided.withColumn("__own", by_side(lambda k: corner(own_x, own_y, s, k)))
        .withColumn("__p0", by_side(lambda k: corner(par_x, par_y, s * 2, k)))
        .withColumn("__p1", by_side(lambda k: corner(par_x, par_y, s * 2, k + 1)))
    )
    starts = (F.col("__own.x") == F.col("__p0.x")) & (F.col("__own.y") == F.col("__p0.y"))
    fine = F.col("neighbour") < F.col("level")
    code = (
        F.when(F.col("neighbour").isNull() | (F.col("neighbour") == F.col("level")), 0)
        .when(F.col("neighbour") > F.col("level"), 2)
        .when(starts, 1)
        .otherwise(3)
    )
    far = F.when(fine, F.when(starts, F.col("__p1")).otherwise(F.col("__p0")))
    return ends.select(
        *CELL, "side", code.alias("code"), far["x"].alias("far_x"), far["y"].alias("far_y")
    )


def patch_corners(
    leaves: DataFrame,
    pixels: DataFrame | None,
    catalog: DataFrame,
    max_level: int,
    frame: Column | None = None,
    images: DataFrame | None = None,
    coarse: int = COARSE,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Four corners of each leaf: lattice position, world and texture coordinates.

    Corners are placed from integer lattice coordinates, so the corner two
    leaves share has the same numbers in both. ``images`` (raster_id,
    image_geo, image_w, image_h) adds texture coordinates in an image;
    ``frame`` adds scene coordinates. ``blocks``: the stored root blocks the
    leaves come from; heights are read there, and no pixel table is needed.
    """
    corners = F.array(
        *(
            F.struct(F.lit(k).alias("corner"), x.cast("int").alias("fx"), y.cast("int").alias("fy"))
            for k, (x, y) in enumerate(corner_lattice(max_level))
        )
    )
    info = catalog.select("raster_id", "width", "height", geo_struct().alias("geo"))
    finest = float(coarse * 2**max_level)
    cornered = within_lattice(leaves.select(*CELL), max_level).withColumn("p", corners)
    if blocks is None:
        placed = cornered.withColumn("p", F.explode("p")).select(*CELL, "p.*")
    else:
        placed = descent.corner_heights(cornered, blocks, finest)
    placed = (
        placed.transform(lambda df: join_catalog(df, info, "raster_id", ["fx", "fy"]))
        .withColumn("px", F.col("fx") * ((F.col("width") - 1) / finest))
        .withColumn("py", F.col("fy") * ((F.col("height") - 1) / finest))
    )
    if blocks is None:
        placed = sample_filled(placed, to_blocks(pixels, ["filled"]), out="z", size=BLOCK)
    world = pixel_to_world("px", "py", F.col("geo"))
    uv = texel_uv("px", "py", "width", "height")
    placed = placed.withColumns({**world, **uv})
    keep = [*CELL, "corner", "fx", "fy", "x", "y", "z", "u", "v"]
    if images is not None:
        iuv = image_uv(
            "px", "py", F.col("geo"), "width", "height", F.col("image_geo"), "image_w", "image_h"
        )
        placed = join_catalog(placed, images, "raster_id", ["fx", "fy"], how="left").withColumns(iuv)
        keep += ["iu", "iv"]
    if frame is not None:
        scene = to_scene("x", "y", "z", F.col("__frame"))
        placed = placed.withColumn("__frame", frame).withColumns(scene)
        keep += ["gx", "gy", "gz"]
    return placed.select(*keep)


def patch_bounds(corners: DataFrame) -> DataFrame:
    """Bounding box of each raster's patch corners."""
    return corners.groupBy("raster_id").agg(
        *(F.min(c).alias(f"min{c}") for c in "xyz"), *(F.max(c).alias(f"max{c}") for c in "xyz")
    )
