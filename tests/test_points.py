from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraframe.functions.rules import depth_at_resolution
from terraframe.operators import catalog as K
from terraframe.operators import points as P


def cloud(spark, xyz, file_id="a"):
    frame = pd.DataFrame(np.asarray(xyz, float), columns=list("xyz"))
    frame.insert(0, "file_idx", np.arange(len(frame)))
    frame.insert(0, "file_id", file_id)
    return spark.createDataFrame(frame)


def square(spark, side=80.0):
    return spark.createDataFrame(
        [("a", 0.0, 0.0, 0.0, side, side, side)],
        "file_id string, minx double, miny double, minz double, maxx double, maxy double, maxz double",
    )


def test_thinning_of_a_dense_lattice(spark):
    side, step = 1600, 0.05
    points = spark.range(side * side, numPartitions=8).select(
        F.lit("a").alias("file_id"),
        F.col("id").alias("file_idx"),
        (F.lit(991000.0) + (F.col("id") % side) * step).alias("x"),
        (F.lit(6557000.0) + F.floor(F.col("id") / side) * step).alias("y"),
        (F.lit(10.0) + F.col("id") % 7).alias("z"),
    )
    bounds = P.cloud_bounds(points)
    kept = P.grid_thin(points, bounds, 2_000_000).select("file_idx").toPandas()["file_idx"].sort_values()
    assert 2_000_000 < len(kept) < 2_050_000
    assert kept.is_unique
    assert (kept // side >= side - 3).sum() > side // 2
    blocks = ((kept // side) * 4 // side) * 4 + (kept % side) * 4 // side
    share = blocks.value_counts()
    assert len(share) == 16
    assert (abs(share - len(kept) // 16) < len(kept) // 160).all()


def test_thinning_does_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(5)
    points = cloud(spark, rng.random((5000, 3)) * 100)
    bounds = P.cloud_bounds(points)
    one = P.grid_thin(points.repartition(1), bounds, 300).toPandas().sort_values("file_idx")
    many = P.grid_thin(points.repartition(13, "x"), bounds, 300).toPandas().sort_values("file_idx")
    assert one["file_idx"].tolist() == many["file_idx"].tolist()
    small = P.grid_thin(points, bounds, 5000)
    assert small.count() == 5000


def test_a_hot_cell_is_kept_whole_and_once(spark):
    rng = np.random.default_rng(1)
    xyz = rng.random((3000, 3)) * 100
    xyz[1000:2200] = xyz[5]
    points = cloud(spark, xyz)
    kept = P.grid_thin(points, P.cloud_bounds(points), 400).toPandas()
    assert 5 in set(kept["file_idx"]) or (kept["file_idx"] < 5).any()
    assert kept[kept["file_idx"].between(1000, 2199)].empty


def lod_cloud(spark):
    parts = []
    for depth, step, offset, z in ((0, 10.0, 0.0, 1.0), (1, 5.0, 2.5, 2.0), (2, 2.5, 1.25, 3.0)):
        at = np.arange(offset, 80.0 - offset + 1e-9, step)
        x, y = np.meshgrid(at, at)
        parts.append(pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": z, "depth": depth}))
    frame = pd.concat(parts, ignore_index=True)
    frame.insert(0, "file_idx", np.arange(len(frame)))
    frame.insert(0, "file_id", "a")
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("resolution, expected", [(10.0, 81), (20.0, 81), (5.0, 337), (2.5, 1361), (0.0, 1361)])
def test_points_by_resolution(spark, resolution, expected):
    wanted = depth_at_resolution(F.lit(10.0), F.lit(2), F.lit(resolution))
    found = lod_cloud(spark).where(F.col("depth") <= wanted)
    tiled = P.points_to_tiles(found, square(spark))
    assert found.count() == expected
    assert P.tile_partition_check(found, tiled).count() == 0


def test_tile_borders_are_half_open(spark):
    points = cloud(spark, [(10.0, 10.0, 1.0), (80.0, 80.0, 1.0), (9.999, 10.0, 1.0), (80.1, 5.0, 1.0)])
    tiles = {r["file_idx"]: (r["gx"], r["gy"]) for r in P.points_to_tiles(points, square(spark)).collect()}
    assert tiles == {0: (1, 1), 1: (7, 7), 2: (0, 1)}


def test_tile_layout(spark):
    tiles = P.tile_boxes(square(spark)).collect()
    assert len(tiles) == 64
    assert all(t["tile"]["maxx"] - t["tile"]["minx"] == 10.0 for t in tiles)
    last = next(t for t in tiles if (t["gx"], t["gy"]) == (7, 7))
    assert last["tile"]["maxx"] == 80.0 and last["tile"]["maxy"] == 80.0


def test_depth_levels_are_nested_thinnings(spark):
    rng = np.random.default_rng(9)
    points = cloud(spark, rng.random((3000, 3)) * 80)
    bounds = P.cloud_bounds(points)
    depths = P.assign_depth(points, bounds, 20.0, 3).toPandas()
    b = bounds.first()
    for d in range(3):
        size = 20.0 / 2**d
        cells = list(zip((depths.x - b.minx) // size, (depths.y - b.miny) // size))
        heads = depths.assign(cell=cells).groupby("cell")["file_idx"].min()
        assert set(depths[depths.depth <= d]["file_idx"]) == set(heads)


@pytest.mark.parametrize("slope", [0.0, 0.3])
def test_tile_box_and_spacing(spark, slope):
    i, j = np.meshgrid(np.arange(100.0), np.arange(100.0))
    points = cloud(spark, np.column_stack([i.ravel(), slope * i.ravel(), j.ravel()]))
    tiled = points.selectExpr("*", "0 AS gx", "0 AS gy")
    t = P.tile_pca(tiled).first()
    normal = np.array([-slope, 1.0, 0.0]) / np.hypot(slope, 1.0)
    assert abs(abs(np.dot(t["a3"], normal)) - 1.0) < 1e-3
    assert t["e3"] < 1e-2
    spacing = np.sqrt(max(12 * t["e1"] * t["e2"], 1e-12) / t["point_count"])
    assert abs(spacing - np.sqrt(np.hypot(1.0, slope))) < 0.02
    axes = np.array([t["a1"], t["a2"], t["a3"]])
    assert np.allclose(axes @ axes.T, np.eye(3), atol=1e-9)


def test_scene_frame(spark):
    box = "minx double, miny double, minz double, maxx double, maxy double, maxz double"
    frame = K.scene_frame(
        spark.createDataFrame([(991000.0, 6557000.0, 746.0, 992000.0, 6559000.0, 1677.0)], box)
    ).first()
    assert (frame["cx"], frame["cy"]) == (991500.0, 6558000.0)
    flat = K.scene_frame(spark.createDataFrame([(0.0, 0.0, None, 300.0, 400.0, None)], box)).first()
    assert flat["scale"] == 500.0 and flat["cz"] == 0.0 and flat["zmax"] > flat["zmin"]
