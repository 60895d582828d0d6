"""Physical plans: what is broadcast, what is shuffled, what is read."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import catalog, pixels
from pyspark.sql import functions as F
from test_quadtree import Model, leaves_of

import __spark_entry__ as entry_module
from terraframe.functions.frame import fine_hash
from terraframe.operators import points as P
from terraframe.operators import raster as R
from terraframe.operators.blocks import to_blocks
from terraframe.operators.descent import drop_unknown_splits, leaves_of_blocks
from terraframe.operators.lookup import join_catalog, known, sized
from terraframe.operators.quadtree import balance_leaves, drop_unknown_leaves
from terraframe.operators.raster import fill_nearest
from terraframe.plans.collection import Collection
from terraframe.plans.quadtree_queries import mixed_pixels
from terraframe.session import stored
from terraframe.sources import read_plan, read_root_blocks, write_lod_points, write_root_blocks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def cloud(spark):
    df = spark.range(40_000).selectExpr(
        "cast(id % 3 AS int) AS file_id", "id AS file_idx", "(id * 37 % 1000) * 0.1D AS x", "(id * 91 % 777) * 0.1D AS y", "id % 50 * 1D AS z"
    )
    return stored(df)


def test_points_are_not_shuffled_before_the_partial_aggregate(spark, cloud):
    bounds = P.cloud_bounds(cloud)  # an aggregate: its size is not known until it is written
    plan = plan_of(P.grid_thin(cloud, bounds, 500))
    assert plan.count("BroadcastExchange") == 1 and "BuildRight" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the final aggregate alone
    assert "Exchange hashpartitioning" not in plan_of(P.points_to_tiles(cloud, bounds))


def test_large_catalogs_are_salted_and_never_built(spark, cloud):
    bounds = P.cloud_bounds(cloud)
    joined = join_catalog(cloud, bounds, "file_id", ["file_idx"], limit=0)
    plan = plan_of(joined)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "ShuffledHashJoin" not in plan and "__salt" in plan
    assert joined.count() == 40_000 and joined.columns == join_catalog(cloud, bounds, "file_id", ["file_idx"]).columns


def test_sizes_are_known_before_a_broadcast(spark, cloud):
    stored_catalog = known(P.cloud_bounds(cloud))
    assert known(stored_catalog) is stored_catalog  # not written twice
    assert "Broadcast" in plan_of(cloud.join(sized(stored_catalog), "file_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan_of(cloud.join(sized(stored_catalog, limit=0), "file_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def broadcast_outputs(df) -> list[str]:
    """Output of each broadcast of a plan, as its leaves print it."""
    found, todo = [], [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "BroadcastHashJoin":
            side = node.right() if "BuildRight" in node.toString().split("\n")[0] else node.left()
            found.append(side.output().mkString(","))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("name", ["colorize_points", "tile_query", "ground_tint", "warp_image"])
def test_generated_blocks_are_not_broadcast(spark, name):
    """A grid is taken to be as small as its catalog: its blocks went through the driver."""
    df = entry_module.queries()[name](spark, "/root/testdata/sf0.001")
    assert not [out for out in broadcast_outputs(df) if "brow" in out]


def test_finer_pixels_come_without_a_join(spark):
    """Each pixel makes its own finer ones; joined, the finer grid was broadcast as if it were as small as its catalog."""
    finer = mixed_pixels(Collection(spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan_of(finer)
    assert finer.where("raster_id % 2 = 1").groupBy("raster_id").count().select("count").distinct().collect() == [(97 * 97,)]


def files_read(df) -> int:
    """Files that the scans of ``df``'s plan opened when it ran."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if node.nodeName().startswith("Scan parquet") and "file_idx" in node.toString():
            total += node.metrics().apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_plan_reads_its_levels_and_tiles_only(spark, cloud, tmp_path):
    bounds = P.cloud_bounds(cloud)
    leveled = P.assign_depth(P.points_to_tiles(cloud, bounds), bounds, 10.0, 3)
    path = str(tmp_path / "lod")
    write_lod_points(leveled, path)
    plan = spark.createDataFrame([(0, 2, 3, 1, "v1"), (1, 2, 3, 0, "v1"), (0, 2, 3, 0, "v2"), (9, 0, 0, 2, "v3")], "file_id int, gx int, gy int, upto int, view string")
    got = read_plan(spark, path, plan)
    assert "dynamicpruning" in plan_of(got)
    want = leveled.join(plan, ["file_id", "gx", "gy"]).where("depth <= upto")
    rows = lambda df: sorted(map(tuple, df.select("view", "file_id", "file_idx", "depth").collect()))
    assert rows(got) == rows(want) and len(rows(want)) > 0
    got = got.select("view", "file_idx")
    got.collect()
    whole = len(spark.read.parquet(path).inputFiles())
    assert 0 < files_read(got) < whole / 8


def test_leaves_from_a_stored_block_table(spark, tmp_path):
    """One table serves several tolerances; what balancing splits is sampled in the same table."""
    rng = np.random.default_rng(12)
    y, x = np.mgrid[0:70, 0:90]
    grid = 8 * np.sin(x / 9.0) * np.cos(y / 13.0) + rng.normal(0, 0.05, (70, 90))
    grid[20:33, 40:61] = np.nan
    table, cat = fill_nearest(pixels(spark, grid)), catalog(spark, 90, 70)
    write_root_blocks(table, cat, str(tmp_path / "blocks"), coarse=2, max_span=12.0)
    blocks = read_root_blocks(spark, str(tmp_path / "blocks"))
    z = np.full(grid.shape, np.nan)
    for r in table.collect():
        z[r["row"], r["col"]] = r["filled"]
    for angle, deepest in ((4.0, 4), (25.0, 3)):
        found = leaves_of_blocks(blocks, deepest, angle, 12.0)
        assert leaves_of(found) == Model(grid, z, 2, deepest, angle, 12.0).leaves()
        balanced = stored(balance_leaves(found, deepest))
        kept = drop_unknown_splits(balanced, stored(found), blocks)
        assert leaves_of(kept) == leaves_of(drop_unknown_leaves(balanced, table.select("raster_id", "row", "col", "v"), cat, 2))
    assert "Exchange" not in plan_of(blocks.selectExpr("size(v)"))


def test_a_raster_without_known_pixels_has_no_leaves(spark):
    grid = np.full((40, 40), np.nan)
    table = pixels(spark, grid).withColumn("filled", F.col("v"))
    from terraframe.operators.quadtree import quadtree_leaves

    assert quadtree_leaves(table, catalog(spark, 40, 40), coarse=2, max_level=2, max_span=8.0).count() == 0


def logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_screen_thinning_works_out_each_term_once(spark):
    """The hash was spelt out over a hundred times in the join's condition, and evaluated so for each point."""
    hashed = spark.range(3).select(F.lit(0.25).alias("x"), F.rand(1).alias("y"), F.rand(2).alias("z")).select(fine_hash("x", "y", "z").alias("h"))
    assert logical(hashed).count("FLOOR") <= 4
    plan = logical(entry_module.queries()["screen_thin"](spark, "/root/testdata/sf0.001"))
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    assert joins and not any("SIN(" in line for line in joins)


def test_depths_are_found_without_multiplying_heads(spark, cloud):
    """Every head was exploded into one row a level: the map of that aggregate took most of a task's memory."""
    bounds = stored(P.cloud_bounds(cloud))
    leveled = P.assign_depth(cloud, bounds, 20.0, 4)
    assert "Generate" not in plan_of(leveled)
    assert plan_of(leveled).count("Exchange hashpartitioning") <= 4
    low = {r["file_id"]: (r["minx"], r["miny"]) for r in bounds.collect()}
    points = [tuple(r) for r in cloud.select("file_id", "file_idx", "x", "y").collect()]
    want = {}
    for d in reversed(range(4)):
        first = {}
        for f, i, x, y in points:
            key = (f, (x - low[f][0]) / 20.0 * 2.0**d // 1, (y - low[f][1]) / 20.0 * 2.0**d // 1)
            first[key] = min(first.get(key, i), i)
        want |= {(key[0], i): d for key, i in first.items()}
    got = {(r["file_id"], r["file_idx"]): r["depth"] for r in leveled.collect()}
    assert got == {(f, i): want.get((f, i), 4) for f, i, _, _ in points}
    one = {r["depth"] for r in P.assign_depth(cloud, bounds, 20.0, 1).select("depth").distinct().collect()}
    assert one == {0, 1}


def test_points_go_from_raster_to_raster_without_being_gathered(spark):
    """Ground from two rasters was one row a point and raster, shuffled once more to bring them together."""
    coarse, fine = pixels(spark, [[np.nan, np.nan], [5.0, 5.0]]), pixels(spark, [[1.0, 2.0], [3.0, np.nan]])
    grounds = [(to_blocks(fill_nearest(g), ["v", "filled"]), catalog(spark, 2, 2, y0=1.0)) for g in (coarse, fine)]
    rows = [(1, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (9.0, 9.0)])]
    points = spark.createDataFrame(rows, "raster_id bigint, k int, x double, y double")
    found = R.drape_first(points, grounds)
    assert {r["k"]: r["ground"] for r in found.collect()} == {0: 5.0, 1: 1.0, 2: 2.0, 3: None}
    plan = logical(entry_module.queries()["first_ground"](spark, "/root/testdata/sf0.001"))
    assert "min_by" not in plan


def test_fill_ships_one_source_a_pixel(spark):
    """Both candidates of a row scan travelled with each pixel; they are made behind the shuffle."""
    plan = plan_of(fill_nearest(pixels(spark, [[1.0, np.nan], [np.nan, 2.0]])))
    sent = [line for line in plan.split("\n") if "Exchange hashpartitioning(raster_id" in line]
    rows = plan.index("Exchange hashpartitioning(raster_id")
    assert len(sent) == 2 and "__toleft" not in plan[rows:] and "__toleft" in plan[:rows]
