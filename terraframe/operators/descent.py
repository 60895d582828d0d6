"""Quadtrees from stored root blocks: judged top-down inside the block, with early stop.

A *root block* holds the pixels of one root cell (the first level that may
keep a cell) with a halo of one pixel, as two arrays. A table of them
(:mod:`terraframe.sources.block_table`) is written once and serves every
operator here; nothing below shuffles pixels. Each row carries its own
frontier of open cells from level to level: a cell is compared with its
pixels only if its samples and its span let it stay, and only until one of
them is too far off; only the children of cells that split are looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.operators.lookup import sized
from terraframe.session import stored

ROOT = ["raster_id", "rx", "ry"]
_CELL = "struct<level:int,ix:int,iy:int>"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _placed(cell: str) -> str:
    """The cell with its size and first corner in pixels."""
    sizes = f"cw0 / pow(2D, cast({cell}.level AS double)) AS cw, ch0 / pow(2D, cast({cell}.level AS double)) AS ch"
    sized_cell = f"struct({cell}.level AS level, {cell}.ix AS ix, {cell}.iy AS iy, {sizes})"
    whole = "struct(p.level AS level, p.ix AS ix, p.iy AS iy, p.cw AS cw, p.ch AS ch, p.ix * p.cw AS pcol, p.iy * p.ch AS prow)"
    return _let(sized_cell, "p", whole)


def _is_unknown(column: str, row: str) -> str:
    return f"CASE WHEN get(v, ({row} - row0) * bw + {column} - col0) IS NULL THEN 1 ELSE 0 END"


def _nearest(low: str, size: str, count: str, share: str) -> str:
    return f"cast(least(floor({low} + {size} * {share} + 0.5D), {count} - 1) AS int)"


def _sample(g: str, x: str, y: str) -> str:
    """1 if the pixel nearest to a place inside the cell is unknown."""
    return _is_unknown(_nearest(f"{g}.pcol", f"{g}.cw", "width", x), _nearest(f"{g}.prow", f"{g}.ch", "height", y))


def _corners_unknown(g: str) -> str:
    return " + ".join(_sample(g, x, y) for x in ("0", "1") for y in ("0", "1"))


def _height(x: str, y: str) -> str:
    """Bilinear height of the filled raster at a place, clamped to the raster."""
    at = "(q.r - row0) * bw + q.c - col0"
    parts = [
        ("(1 - q.fc) * (1 - q.fr)", at),
        ("q.fc * (1 - q.fr)", f"{at} + 1"),
        ("(1 - q.fc) * q.fr", f"{at} + bw"),
        ("q.fc * q.fr", f"{at} + bw + 1"),
    ]
    # A zero weight may point past the block: its value is not looked at.
    total = " + ".join(f"CASE WHEN {w} > 0 THEN {w} * get(filled, {p}) ELSE 0D END" for w, p in parts)
    clamped = f"struct(least(greatest({x}, 0D), width - 1D) AS x, least(greatest({y}, 0D), height - 1D) AS y)"
    split = "struct(cast(floor(o.x) AS int) AS c, o.x - floor(o.x) AS fc, cast(floor(o.y) AS int) AS r, o.y - floor(o.y) AS fr)"
    return _let(_let(clamped, "o", split), "q", total)


def _over_pixels(g: str, of_area) -> str:
    """``of_area(rows, bind, columns, gap)`` with the pieces to walk over a cell's pixels.

    rows, columns: arrays of the pixels ``r`` and ``c`` inside; bind: puts the
    patch's heights on both ends of line ``r`` around its argument; gap: the distance of pixel (r, c) from the patch, null if it is unknown.
    """
    ends = {
        f"e{i}{j}": _height(f"{g}.pcol + {g}.cw" if i else f"{g}.pcol", f"{g}.prow + {g}.ch" if j else f"{g}.prow")
        for i in (0, 1)
        for j in (0, 1)
    }

    def inside(low: str, size: str, count: str) -> str:
        first, last = f"cast(ceil({low}) AS int)", f"least(cast(floor({low} + {size}) AS int), {count} - 1)"
        return f"CASE WHEN {first} <= {last} THEN sequence({first}, greatest({first}, {last})) ELSE cast(array() AS array<int>) END"

    t = f"(r - {g}.prow) / {g}.ch"
    edge = f"struct(e.e00 + (e.e01 - e.e00) * ({t}) AS l, e.e10 + (e.e11 - e.e10) * ({t}) AS r)"
    gap = f"abs(get(v, (r - row0) * bw + c - col0) - (y.l + (y.r - y.l) * ((c - {g}.pcol) / {g}.cw)))"
    rows, columns = inside(f"{g}.prow", f"{g}.ch", "height"), inside(f"{g}.pcol", f"{g}.cw", "width")
    area = of_area(rows, lambda line: _let(edge, "y", line), "e.cs", gap)
    # the columns of a cell are the same for each of its lines
    return _let("struct(" + ", ".join(f"{x} AS {k}" for k, x in ends.items()) + f", {columns} AS cs)", "e", area)


def _deviation(g: str) -> str:
    """Largest distance of a known pixel of the cell from the patch through its corners, 0 if it has none."""

    def area(rows: str, bind, columns: str, gap: str) -> str:
        line = f"aggregate({columns}, m, (n, c) -> greatest(n, {gap}))"
        return f"aggregate({rows}, 0D, (m, r) -> {bind(line)})"

    return _over_pixels(g, area)


def _exceeds(g: str, limit: str) -> str:
    """Whether any known pixel of the cell is farther than ``limit`` from its patch; stops at the first."""

    def area(rows: str, bind, columns: str, gap: str) -> str:
        line = f"exists({columns}, c -> coalesce({gap} > e.limit, false))"
        return f"exists({rows}, r -> {bind(line)})"

    return _over_pixels(g, area).replace(" AS cs)", f" AS cs, {limit} AS limit)", 1)


def cell_stats(blocks: DataFrame, max_level: int) -> DataFrame:
    """Every cell from the root level to ``max_level`` (the root level, if that is deeper): ``deviation, unknown, centre_unknown``."""
    deepest = f"greatest(root_level, {max_level})"
    of_level = (
        "flatten(transform(sequence(0, shiftleft(1, l - root_level) - 1), i -> transform(sequence(0, shiftleft(1, l - root_level) - 1), j ->"
        " struct(l AS level, shiftleft(rx, l - root_level) + i AS ix, shiftleft(ry, l - root_level) + j AS iy))))"
    )
    judged = _let(
        _placed("k"),
        "g",
        f"struct(g.level AS level, g.ix AS ix, g.iy AS iy, {_deviation('g')} AS deviation,"
        f" {_corners_unknown('g')} + {_sample('g', '0.5D', '0.5D')} AS unknown, {_sample('g', '0.5D', '0.5D')} AS centre_unknown)",
    )
    cells = f"transform(flatten(transform(sequence(root_level, {deepest}), l -> {of_level})), k -> {judged})"
    return blocks.selectExpr("raster_id", f"explode({cells}) AS s").selectExpr("raster_id", "s.*")


def _marks(blocks: DataFrame, max_level: int, angle: float, max_span: float) -> DataFrame:
    """Leaves under each root, and the unknown samples of coarser cells (``sample``) that a root's corners are."""
    tangent = math.tan(math.radians(angle))
    small = f"greatest(g.cw, g.ch) <= {float(max_span)!r}D"
    flat = f"NOT {_exceeds('g', f'{tangent!r}D * least(g.cw * pw, g.ch * ph) * 0.5D')}"
    fate = (
        # cells of the deepest level don't split, flat or not: their pixels are not looked at
        f"CASE WHEN u.corners + u.centre = 5 THEN 'drop' WHEN g.level >= {max_level} THEN CASE WHEN u.centre = 1 THEN 'drop' ELSE 'leaf' END"
        f" WHEN u.corners + u.centre = 0 AND {small} AND {flat} THEN 'leaf' ELSE 'split' END"
    )
    samples = f"struct({_corners_unknown('g')} AS corners, {_sample('g', '0.5D', '0.5D')} AS centre)"
    judged = _let(_placed("k"), "g", _let(samples, "u", f"struct(g.level AS level, g.ix AS ix, g.iy AS iy, {fate} AS fate)"))
    bare = "struct(x.level AS level, x.ix AS ix, x.iy AS iy)"
    below = "transform(array(0, 1, 2, 3), n -> struct(x.level + 1 AS level, x.ix * 2 + (n & 1) AS ix, x.iy * 2 + shiftright(n, 1) AS iy))"
    step = _let(
        f"transform(a.open, k -> {judged})",
        "j",
        f"struct(flatten(transform(filter(j, x -> x.fate = 'split'), x -> {below})) AS open,"
        f" concat(a.leaves, transform(filter(j, x -> x.fate = 'leaf'), x -> {bare})) AS leaves)",
    )
    start = (
        f"struct(cast(array(struct(root_level AS level, rx AS ix, ry AS iy)) AS array<{_CELL}>) AS open,"
        f" cast(array() AS array<{_CELL}>) AS leaves)"
    )
    leaves = f"aggregate(sequence(root_level, greatest(root_level, {max_level})), {start}, (a, l) -> {step}, a -> a.leaves)"
    tagged = "struct(x.level AS level, x.ix AS ix, x.iy AS iy, {} AS sample)"
    both = f"concat(transform({leaves}, x -> {tagged.format('false')}), transform({_coarse_samples()}, x -> {tagged.format('true')}))"
    return blocks.selectExpr(*ROOT, "root_level", f"explode({both}) AS s").selectExpr(*ROOT, "root_level", "s.*")


def _coarse_samples() -> str:
    """Unknown samples of the cells above the root level. All of them lie on corners of roots; each corner belongs to one root."""
    corner = (
        "filter(array(struct(0 AS x, 0 AS y), struct(1 AS x, 0 AS y), struct(0 AS x, 1 AS y), struct(1 AS x, 1 AS y)),"
        " c -> (c.x = 0 OR rx = roots - 1) AND (c.y = 0 OR ry = roots - 1))"
    )
    ends = "array(struct(0D AS x, 0D AS y), struct(1D AS x, 0D AS y), struct(0D AS x, 1D AS y), struct(1D AS x, 1D AS y))"
    # a corner of roots is a corner of up to four cells of a level, the centre of one, or nothing
    shares = (
        f"CASE WHEN p.x % p.n = 0 AND p.y % p.n = 0 THEN {ends} WHEN p.x % p.n * 2 = p.n AND p.y % p.n * 2 = p.n"
        " THEN array(struct(0.5D AS x, 0.5D AS y)) ELSE cast(array() AS array<struct<x:double,y:double>>) END"
    )
    off_x, off_y = "(p.x - cast(s.x * p.n AS int))", "(p.y - cast(s.y * p.n AS int))"
    valid = f"{off_x} >= 0 AND {off_y} >= 0 AND {off_x} < roots AND {off_y} < roots"
    cell = f"struct(l AS level, cast({off_x} div p.n AS int) AS ix, cast({off_y} div p.n AS int) AS iy)"
    known = f"({_let(_placed('k'), 'g', _is_unknown(_nearest('g.pcol', 'g.cw', 'width', 's.x'), _nearest('g.prow', 'g.ch', 'height', 's.y')))}) = 1"
    found = f"CASE WHEN {valid} THEN {_let(cell, 'k', f'CASE WHEN {known} THEN k END')} END"
    place = "struct(rx + c.x AS x, ry + c.y AS y, shiftleft(1, root_level - l) AS n)"
    per_level = f"flatten(transform({corner}, c -> {_let(place, 'p', f'transform({shares}, s -> {found})')}))"
    levels = "filter(sequence(-1, root_level - 1), l -> l >= 0)"
    return f"filter(flatten(transform({levels}, l -> {per_level})), k -> k IS NOT NULL)"


def leaves_of_blocks(blocks: DataFrame, max_level: int, angle: float, max_span: float) -> DataFrame:
    """``raster_id, level, ix, iy`` of the leaves; what is judged is written once, since two steps look at it.

    blocks: a stored table of root blocks. A cell above the root level whose
    five samples are all unknown goes whole, with all that is below it.
    """
    marks = stored(_marks(blocks, max_level, angle, max_span))
    blank = marks.where("sample").groupBy("raster_id", "level", "ix", "iy", "root_level").count().where("count = 5")
    gone = (
        blank.selectExpr("*", "shiftleft(1, root_level - level) AS k")
        .selectExpr("raster_id", "k", "iy", "explode(sequence(ix * k, ix * k + k - 1)) AS rx")
        .selectExpr("raster_id", "rx", "explode(sequence(iy * k, iy * k + k - 1)) AS ry")
        .distinct()
    )
    return marks.where("NOT sample").join(gone, ROOT, "left_anti").select("raster_id", "level", "ix", "iy")


def drop_unknown_splits(balanced: DataFrame, leaves: DataFrame, blocks: DataFrame) -> DataFrame:
    """Balanced leaves without those whose centre, or all samples, are unknown.

    A leaf that the descent itself kept has passed that test; only the pieces
    of leaves that balancing split are sampled, in the blocks they lie in.
    """
    cell = ["raster_id", "level", "ix", "iy"]
    new = stored(balanced.join(leaves.select(*cell), cell, "left_anti"))
    if new.isEmpty():
        return balanced.select(*cell)
    roots = sized(stored(blocks.select("raster_id", "root_level").distinct()))
    by_root = (
        new.join(roots, "raster_id")
        .selectExpr(*cell, "shiftright(ix, level - root_level) AS rx", "shiftright(iy, level - root_level) AS ry")
        .groupBy(*ROOT)
        .agg(F.collect_list(F.struct("level", "ix", "iy")).alias("cells"))  # cells of one root: bounded by the lattice
    )
    met = blocks.join(sized(stored(by_root)), ROOT)
    samples = f"struct({_corners_unknown('g')} AS corners, {_sample('g', '0.5D', '0.5D')} AS centre)"
    judged = _let(_placed("k"), "g", _let(samples, "u", "struct(g.level AS level, g.ix AS ix, g.iy AS iy, u.centre AS centre)"))
    gone = met.selectExpr("raster_id", f"explode(transform(cells, k -> {judged})) AS s").selectExpr("raster_id", "s.*")
    return balanced.join(gone.where("centre = 1").drop("centre"), cell, "left_anti").select(*cell)


def corner_heights(cornered: DataFrame, blocks: DataFrame, finest: float) -> DataFrame:
    """Leaves with their corners ``p`` (array of corner, fx, fy on a lattice of ``finest`` cells a side) to one row a corner, with its height ``z``.

    A leaf's corners lie in the block of its own root, so no pixel is shuffled, and what joins the blocks is leaves, not corners.
    """
    cell = ["raster_id", "level", "ix", "iy"]
    roots = sized(stored(blocks.select("raster_id", "root_level").distinct()))
    keyed = cornered.join(roots, "raster_id").selectExpr(
        *cell, "p", "shiftright(ix, level - root_level) AS rx", "shiftright(iy, level - root_level) AS ry"
    )
    met = keyed.join(blocks.select(*ROOT, "row0", "col0", "bw", "filled", "width", "height"), ROOT)
    z = _height(f"(k.fx * ((width - 1) / {finest!r}D))", f"(k.fy * ((height - 1) / {finest!r}D))")
    corners = f"transform(p, k -> struct(k.corner AS corner, k.fx AS fx, k.fy AS fy, {z} AS z))"
    return met.selectExpr(*cell, f"explode({corners}) AS p").select(*cell, "p.*")
