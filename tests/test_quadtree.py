from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import catalog, filled, pixels
from pyspark.sql import functions as F

from terraframe.functions.rules import level_for_span
from terraframe.operators import quadtree as Q
from terraframe.operators.raster import fill_nearest, grid_pixels

NAN = float("nan")


def leaves_of(df):
    return {(r["level"], r["ix"], r["iy"]) for r in df.collect()}


def leaves(spark, grid, **options):
    h, w = grid.shape
    return Q.quadtree_leaves(fill_nearest(pixels(spark, grid)), catalog(spark, w, h), **options)


class Model:
    """The definition, recursively, on NumPy arrays."""

    def __init__(self, known, filled_values, coarse, max_level, angle, span):
        self.v, self.z = known, filled_values
        self.h, self.w = known.shape
        self.coarse, self.angle, self.span = coarse, angle, span
        cell = max((self.w - 1) / coarse, (self.h - 1) / coarse)
        need = next(k for k in range(21) if cell <= span * 2**k or k == 20)
        self.max_level = max(max_level, need)

    def sample(self, x, y):
        x, y = min(max(x, 0), self.w - 1), min(max(y, 0), self.h - 1)
        c, r = int(x), int(y)
        c1, r1 = min(c + 1, self.w - 1), min(r + 1, self.h - 1)
        fx, fy = x - c, y - r
        z = self.z
        return (z[r, c] * (1 - fx) + z[r, c1] * fx) * (1 - fy) + (z[r1, c] * (1 - fx) + z[r1, c1] * fx) * fy

    def gap(self, x, y):
        return np.isnan(self.v[min(int(y + 0.5), self.h - 1), min(int(x + 0.5), self.w - 1)])

    def build(self, level, ix, iy, out):
        n = self.coarse * 2**level
        cw, ch = (self.w - 1) / n, (self.h - 1) / n
        x, y = ix * cw, iy * ch
        centre = self.gap(x + cw / 2, y + ch / 2)
        unknown = centre + sum(self.gap(x + i * cw, y + j * ch) for i in (0, 1) for j in (0, 1))
        if unknown == 5:
            return
        if unknown == 0 and max(cw, ch) <= self.span:
            e = [[self.sample(x + i * cw, y + j * ch) for j in (0, 1)] for i in (0, 1)]
            worst = 0.0
            for r in range(math.ceil(y), min(self.h - 1, math.floor(y + ch)) + 1):
                for c in range(math.ceil(x), min(self.w - 1, math.floor(x + cw)) + 1):
                    if not np.isnan(self.v[r, c]):
                        t, s = (r - y) / ch, (c - x) / cw
                        left, right = e[0][0] + (e[0][1] - e[0][0]) * t, e[1][0] + (e[1][1] - e[1][0]) * t
                        worst = max(worst, abs(self.v[r, c] - (left + (right - left) * s)))
            if worst <= math.tan(math.radians(self.angle)) * min(cw, ch) / 2:
                out.add((level, ix, iy))
                return
        if level >= self.max_level:
            if not (unknown > 0 and centre):
                out.add((level, ix, iy))
            return
        for k in range(4):
            self.build(level + 1, 2 * ix + (k & 1), 2 * iy + (k >> 1), out)

    def leaves(self):
        out = set()
        for i in range(self.coarse**2):
            self.build(0, i % self.coarse, i // self.coarse, out)
        return out


def covering(cells, top):
    """Finest-lattice map of leaf levels, -1 where nothing is left."""
    n = max(((ix + 1) << (top - lv) for lv, ix, iy in cells), default=0)
    n = max(n, max(((iy + 1) << (top - lv) for lv, ix, iy in cells), default=0))
    m = np.full((n, n), -1)
    for lv, ix, iy in cells:
        s = 1 << (top - lv)
        m[iy * s : (iy + 1) * s, ix * s : (ix + 1) * s] = lv
    return m


def balance_by_passes(cells, top):
    """Simultaneous passes until nothing changes."""
    while True:
        m = covering(cells, top)
        split = set()
        for lv, ix, iy in cells:
            s = 1 << (top - lv)
            x, y = ix * s, iy * s
            around = [m[y - 1, x : x + s]] if y else []
            around += [m[y : y + s, x - 1]] if x else []
            around += [m[y + s, x : x + s]] if y + s < len(m) else []
            around += [m[y : y + s, x + s]] if x + s < len(m) else []
            if any((a > lv + 1).any() for a in around):
                split.add((lv, ix, iy))
        if not split:
            return cells
        cells = (cells - split) | {
            (lv + 1, 2 * ix + (k & 1), 2 * iy + (k >> 1)) for lv, ix, iy in split for k in range(4)
        }


def test_deviation_of_a_plane_and_of_one_pixel(spark):
    y, x = np.mgrid[0:65, 0:65]
    plane = filled(pixels(spark, 100 + 0.3 * x - 0.7 * y))
    cat = catalog(spark, 65, 65)
    stats = Q.cell_stats(plane, cat, coarse=1, max_level=2)
    assert stats.agg(F.max("deviation")).first()[0] < 1e-9
    raised = np.full((65, 65), 50.0)
    raised[37, 21] = 52.5
    table = pixels(spark, raised).withColumn("filled", F.col("v"))
    whole = Q.cell_stats(table, cat, coarse=1, max_level=0).first()
    assert whole["deviation"] == pytest.approx(2.5) and whole["unknown"] == 0
    gone = table.withColumn("v", F.expr("CASE WHEN row = 37 AND col = 21 THEN NULL ELSE v END"))
    assert Q.cell_stats(gone, cat, coarse=1, max_level=0).first()["deviation"] < 1e-9


def test_planes_stay_coarse(spark):
    y, x = np.mgrid[0:257, 0:257]
    small = leaves_of(leaves(spark, 10 + 0.5 * x + 0.2 * y))
    assert len(small) == 64 and {lv for lv, _, _ in small} == {0}
    capped = leaves_of(leaves(spark, 10 + 0.5 * x[:129, :129], max_span=8.0))
    assert len(capped) == 256 and {lv for lv, _, _ in capped} == {1}


def test_a_spike_divides_its_surroundings(spark):
    z = np.tile(0.05 * np.arange(257.0), (257, 1))
    z[100, 150] += 5
    found = leaves_of(leaves(spark, z, max_level=4))
    levels = [lv for lv, _, _ in found]
    assert levels.count(4) >= 1 and levels.count(0) >= 60 and len(found) < 64 + 4 * 4 * 3


def test_larger_angles_give_fewer_leaves(spark):
    rng = np.random.default_rng(7)
    y, x = np.mgrid[0:129, 0:129]
    z = 20 * np.sin(x / 60.0) * np.cos(y / 45.0) + rng.normal(0, 0.05, x.shape)
    counts = [leaves(spark, z, angle=a).count() for a in (0.5, 2.0, 20.0)]
    assert counts == sorted(counts, reverse=True) and counts[-1] * 4 < counts[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaves_and_balance_match_the_definition(spark, seed):
    rng = np.random.default_rng(seed)
    h, w = (41, 53) if seed != 2 else (50, 50)
    z = np.full((h, w), 10.0)
    for _ in range(5):
        z[rng.integers(0, h), rng.integers(0, w)] += 9.0
    r0, c0 = rng.integers(0, h - 15), rng.integers(0, w - 15)
    z[r0 : r0 + 14, c0 : c0 + 12] = NAN
    table = fill_nearest(pixels(spark, z)).persist()
    full = table.toPandas().sort_values(["row", "col"])["filled"].to_numpy(float).reshape(h, w)
    options = {"coarse": 2, "max_level": 4, "max_span": 10.0}
    model = Model(z, full, 2, 4, 5.0, 10.0)
    want = model.leaves()
    cat = catalog(spark, w, h)
    found = Q.quadtree_leaves(table, cat, angle=5.0, **options)
    assert leaves_of(found) == want
    balanced = Q.balance_leaves(found, model.max_level)
    assert leaves_of(balanced) == balance_by_passes(want, model.max_level)
    kept = leaves_of(Q.drop_unknown_leaves(balanced, table, cat, 2))
    assert kept <= leaves_of(balanced) and kept
    table.unpersist()


def test_edge_codes_agree(spark):
    z = np.tile(0.01 * np.arange(129.0), (129, 1))
    for k in range(4):
        z[20 + 25 * k, 100 - 20 * k] += 6
    top = 4
    tree = Q.balance_leaves(leaves(spark, z, coarse=4, max_level=top), top)
    cells = leaves_of(tree)
    area = sum(4 ** (top - lv) for lv, _, _ in cells)
    assert area == (4 << top) ** 2
    m = covering(cells, top)
    assert (abs(np.diff(m, axis=0)) <= 1).all() and (abs(np.diff(m, axis=1)) <= 1).all()
    codes = {}
    for r in Q.edge_codes(tree, top).collect():
        codes[(r["level"], r["ix"], r["iy"]), r["side"]] = (r["code"], (r["far_x"], r["far_y"]))
    shift = ((0, 0), (1, 0), (1, 1), (0, 1))

    def corner(cell, k):
        lv, ix, iy = cell
        s = 1 << (top - lv)
        dx, dy = shift[k % 4]
        return ((ix + dx) * s, (iy + dy) * s)

    owner = {}
    for lv, ix, iy in cells:
        s = 1 << (top - lv)
        for y in range(iy * s, (iy + 1) * s):
            for x in range(ix * s, (ix + 1) * s):
                owner[x, y] = (lv, ix, iy)
    transitions = 0
    n = 4 << top
    for y in range(n):
        for x in range(n - 1):
            left, right = owner[x, y], owner[x + 1, y]
            if left == right:
                continue
            (ca, fa), (cb, fb) = codes[left, 1], codes[right, 3]
            if left[0] == right[0]:
                assert ca == 0 and cb == 0
                continue
            transitions += 1
            coarse, fine, side, code, far = (
                (left, right, 3, cb, fb) if left[0] < right[0] else (right, left, 1, ca, fa)
            )
            assert codes[coarse, 1 if coarse is left else 3][0] == 2 and code in (1, 3)
            shared = corner(fine, side) if code == 1 else corner(fine, side + 1)
            across = 1 if coarse is left else 3
            assert {shared, far} == {corner(coarse, across), corner(coarse, across + 1)}
    assert transitions > 0


def test_level_at(spark):
    tree = spark.createDataFrame([(1, 0, 0, 0), (1, 2, 5, 1)], "raster_id bigint, level int, ix int, iy int")
    rows = [(1, i, *p) for i, p in enumerate([(0, 0), (3, 3), (5, 1), (6, 1), (-1, 0), (8, 0)])]
    probes = spark.createDataFrame(rows, "raster_id bigint, probe int, fx int, fy int")
    found = {r["probe"]: r["found"] for r in Q.leaf_at(probes, tree, ["raster_id", "probe"], 2).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: None, 4: None, 5: None}


def test_level_for_span(spark):
    rows = [(19999 / 8, 19999 / 8), (1999 / 8, 1999 / 8), (64.0, 10.0), (10.0, 64.5)]
    df = spark.createDataFrame(rows, "w double, h double")
    assert [r[0] for r in df.select(level_for_span("w", "h", 64.0)).collect()] == [6, 2, 0, 1]


def test_one_raster_is_many_tasks(spark):
    """Neither the catalog join nor the packing may partition by raster alone."""
    table = filled(pixels(spark, np.ones((20, 20))))
    plan = leaves_plan(table, catalog(spark, 20, 20))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    keys = [line.split("hashpartitioning(")[1].split(")")[0].split(", ")[:-1] for line in exchanges]
    assert any(len(k) == 3 and k[1].startswith("rx#") and k[2].startswith("ry#") for k in keys)
    assert not any(len(k) == 1 and k[0].startswith("raster_id#") for k in keys[:1])


def leaves_plan(table, cat):
    stats = Q.cell_stats(table, cat, coarse=2, max_level=2, max_span=10.0)
    return stats._jdf.queryExecution().executedPlan().toString()


def test_leaf_below_the_lattice_raises(spark):
    leaves = spark.createDataFrame([(1, 0, 0, 0), (1, 3, 60, 60)], "raster_id long, level int, ix int, iy int")
    for work in (Q.balance_leaves, Q.neighbour_levels, Q.edge_codes):
        with pytest.raises(Exception, match="below max_level 1"):
            work(leaves, 1).collect()


def test_two_sizes_share_the_deepest_lattice(spark):
    """A raster wider than one block and too large for the asked level, beside a small one: balanced and without holes."""
    catalog = spark.createDataFrame(
        [(1, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 65, 65), (2, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 17, 17)],
        "raster_id long, a double, b double, c double, d double, e double, f double, width int, height int",
    )
    setup = {"coarse": 2, "max_level": 1, "max_span": 8.0}
    deepest = Q.deepest_level(catalog, **setup)
    assert deepest == 2
    flat = grid_pixels(catalog).select("raster_id", "row", "col", F.when((F.col("row") == 7) & (F.col("col") == 9), 9.0).otherwise(1.0).alias("v"))
    leaves = Q.quadtree_leaves(flat.withColumn("filled", F.col("v")), catalog, angle=5.0, **setup)
    done = Q.balance_leaves(leaves, deepest)
    area = {r[0]: r[1] for r in done.groupBy("raster_id").agg(F.sum(F.pow(F.lit(4.0), -F.col("level")))).collect()}
    assert area == {1: 4.0, 2: 4.0}
    sides = Q.neighbour_levels(done, deepest).where(F.abs(F.col("level") - F.col("neighbour")) > 1)
    assert sides.count() == 0
    assert Q.edge_codes(done, deepest).count() == 4 * done.count()


def test_level_at_tries_no_more_levels_than_there_are(spark):
    """Leaves of the last levels are looked up in one row of their cell: probes are neither multiplied nor joined to themselves."""
    tree = spark.createDataFrame([(1, 2, 0, 0), (1, 3, 2, 1), (1, 4, 7, 7)], "raster_id bigint, level int, ix int, iy int")
    rows = [(1, i, *p) for i, p in enumerate([(3, 3), (4, 3), (5, 2), (7, 7), (6, 7), (-1, 0), (16, 0)])]
    probes = spark.createDataFrame(rows, "raster_id bigint, probe int, fx int, fy int")
    looked = Q.leaf_at(probes, tree, ["raster_id", "probe"], 4)
    assert {r["probe"]: r["found"] for r in looked.collect()} == {0: 2, 1: 3, 2: 3, 3: 4, 4: None, 5: None, 6: None}
    plan = looked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Generate" not in plan
    # coarser leaves than those: their levels are tried one by one
    mixed = tree.unionByName(spark.createDataFrame([(1, 0, 1, 0)], tree.schema))
    assert {r["probe"]: r["found"] for r in Q.leaf_at(probes, mixed, ["raster_id", "probe"], 4).collect()} == {0: 2, 1: 3, 2: 3, 3: 4, 4: None, 5: None, 6: 0}


def test_corner_heights_from_root_blocks(spark):
    """Heights at patch corners are the same from the stored root blocks as from the pixels, which are not shuffled again."""
    table, cat = filled(pixels(spark, np.random.default_rng(3).normal(0, 5, (25, 25)))), catalog(spark, 25, 25)
    blocks = Q.root_blocks(table, cat, 2, 8.0)
    tree = Q.quadtree_leaves(table, cat, coarse=2, max_level=3, angle=60.0, max_span=8.0)
    plain = Q.patch_corners(tree, table, cat, 3, coarse=2)
    read = Q.patch_corners(tree, None, cat, 3, coarse=2, blocks=blocks)
    assert sorted(read.collect()) == sorted(plain.collect())


def test_blocks_cut_from_whole_rasters(spark):
    """Rasters packed once and cut in their row give the root blocks that their pixels give, whatever their sizes."""
    rng = np.random.default_rng(8)
    sizes = {1: (25, 25), 2: (97, 97), 3: (41, 70)}
    grids = {k: np.where(rng.random(s) < 0.2, np.nan, rng.random(s)) for k, s in sizes.items()}
    parts = [pixels(spark, grids[k], k) for k in sizes]
    cats = [catalog(spark, w, h, raster_id=k) for k, (h, w) in sizes.items()]
    table = parts[0].unionByName(parts[1]).unionByName(parts[2]).selectExpr("*", "coalesce(v, 25D) AS filled")
    cat = cats[0].unionByName(cats[1]).unionByName(cats[2])
    rasters = Q.whole_rasters(table, ["v", "filled"], cat)
    cut, packed = Q.root_blocks_of_rasters(rasters, 2, 8.0), Q.root_blocks(table, cat, 2, 8.0)
    assert cut.columns == packed.columns and cut.dtypes == packed.dtypes
    assert cut.count() == packed.count() == 16 + 256 + 256
    assert cut.exceptAll(packed).count() == 0
    with pytest.raises(Exception, match="not as its catalog says"):
        Q.root_blocks_of_rasters(Q.whole_rasters(table, ["v", "filled"], cat.withColumn("height", F.col("height") + 1)), 2, 8.0).collect()
