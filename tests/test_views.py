from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraframe.functions.crs import LAMBERT_WGS84, horizontal_epsg, reproject
from terraframe.functions.crs_columns import cone, crs_parameters, known_parameters, same_crs, to_degrees, to_metres
from terraframe.operators import catalog as K
from terraframe.operators import lod as L
from terraframe.operators.boxes import overlap_join
from terraframe.plans.catalog_queries import LAMBERT_PROJ


def boxes(spark, array, key, name):
    rows = [(i, tuple(map(float, b))) for i, b in enumerate(array)]
    return spark.createDataFrame(rows, f"{key} int, {name} struct<minx:double,miny:double,maxx:double,maxy:double>")


def random_boxes(rng, n, sizes):
    low = rng.random((n, 2)) * 100 - 50
    return np.hstack([low, low + rng.choice(sizes, (n, 1)) * rng.random((n, 2))])


def test_overlap_join_is_the_theta_join(spark):
    rng = np.random.default_rng(8)
    a, b = random_boxes(rng, 150, [0.0, 1.0, 30.0, 200.0]), random_boxes(rng, 150, [0.5, 8.0, 90.0])
    a[50:100] = a[50]  # a third of one side at one place
    want = {
        (i, j)
        for i, p in enumerate(a)
        for j, q in enumerate(b)
        if p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1]
    }
    got = overlap_join(boxes(spark, a, "i", "a"), boxes(spark, b, "j", "b"), "a", "b")
    pairs = [(r["i"], r["j"]) for r in got.select("i", "j").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    points = np.hstack([a[:, :2], a[:, :2]])
    at = overlap_join(boxes(spark, points, "i", "a"), boxes(spark, b, "j", "b"), "a", "b", left_points=True)
    pairs = [(r["i"], r["j"]) for r in at.select("i", "j").collect()]
    inside = {(i, j) for i, p in enumerate(points) for j, q in enumerate(b) if q[0] <= p[0] <= q[2] and q[1] <= p[1] <= q[3]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == inside


def test_overlap_join_has_no_nested_loop(spark):
    rng = np.random.default_rng(8)
    got = overlap_join(
        boxes(spark, random_boxes(rng, 9, [3.0]), "i", "a"), boxes(spark, random_boxes(rng, 9, [3.0]), "j", "b"), "a", "b"
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def tiles(spark, n=200, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        low = rng.random(3) * [100, 5, 100]
        high = low + rng.random(3) * [8, 4, 8]
        rows.append((i, 0, 0, 100, 60.0, 3.0, 2.0, 0.5, [1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0],
                     tuple(map(float, (low[0], low[1], low[2], high[0], high[1], high[2])))))
    return spark.createDataFrame(
        rows,
        "file_id int, gx int, gy int, point_count int, tile_area double, e1 double, e2 double, e3 double,"
        " a1 array<double>, a2 array<double>, a3 array<double>,"
        " box struct<lox:double,loy:double,loz:double,hix:double,hiy:double,hiz:double>",
    )


def test_nearer_views_need_finer_tiles(spark):
    tile = spark.createDataFrame(
        [("a", 3, 3, 2500, 100.0, 0.026, 0.026, 0.0, [1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0], (0.0, 0.0, 0.0, 0.1, 0.0, 0.1))],
        tiles(spark, 1).schema.simpleString().replace("struct<file_id:int", "struct<file_id:string", 1),
    )
    views = spark.createDataFrame([(d, 0.05, float(d), 0.05) for d in (0.05, 0.5, 500.0)], "view_id double, ex double, ey double, ez double")
    got = {r["view_id"]: r["desired"] for r in L.desired_resolution(L.views_tiles(views, tile)).collect()}
    assert 0.1 <= got[0.05] < got[0.5]
    assert 500.0 not in got  # a few pixels: left as it is


def test_frustum_against_corner_test(spark):
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.random(3) * [100, 20, 100]), float(rng.random() * 6.3), float(rng.random() - 0.3)) for i in range(12)]
    views = spark.createDataFrame(rows, "view_id int, ex double, ey double, ez double, yaw double, pitch double")
    table = tiles(spark)
    fov, aspect, near, far = 50.0, 1.5, 1.0, 40.0
    got = {(r["view_id"], r["file_id"]) for r in L.view_frustum(views, table, fov, aspect, near, far).collect()}
    ty = math.tan(math.radians(fov) / 2)
    want = set()
    for view, ex, ey, ez, yaw, pitch in rows:
        ahead = np.array([-math.cos(pitch) * math.sin(yaw), -math.sin(pitch), -math.cos(pitch) * math.cos(yaw)])
        right = np.cross(ahead, [0, 1, 0])
        right /= np.linalg.norm(right)
        up = np.cross(right, ahead)
        for t in table.collect():
            b = t["box"]
            corners = np.array([[x, y, z] for x in (b["lox"], b["hix"]) for y in (b["loy"], b["hiy"]) for z in (b["loz"], b["hiz"])]) - [ex, ey, ez]
            d, x, y = corners @ ahead, corners @ right, corners @ up
            w = d * ty * aspect
            outside = [x < -w, x > w, y < -d * ty, y > d * ty, d < near, d > far]
            if not any(o.all() for o in outside):
                want.add((view, t["file_id"]))
    assert got == want and want


def test_crs_codes(spark):
    wgs = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","6326"]],AUTHORITY["EPSG","4326"]]'
    wkt2 = 'PROJCRS["RGF93",BASEGEOGCRS["RGF93",ID["EPSG",4171]],ID["EPSG",2154]]'
    texts = ["EPSG:2154", "EPSG:2154+5720", wgs, wkt2, "", None, 'PROJCS["x",UNIT["metre",1]]']
    df = spark.createDataFrame([(t,) for t in texts], "wkt string")
    assert [r[0] for r in df.select(horizontal_epsg("wkt")).collect()] == [2154, 2154, 4326, 2154, 0, 0, 0]


def test_projection_range_and_round_trip(spark):
    box = spark.createDataFrame([(1, 6.75, 46.03, 6.80, 46.07)], "id int, minx double, miny double, maxx double, maxy double")
    m = K.edge_extent(box, 4326, 2154).first()
    assert 980000 < m["minx"] and m["maxx"] < 1000000 and 6550000 < m["miny"] and m["maxy"] < 6565000
    df = spark.createDataFrame(pd.DataFrame({"x": np.linspace(-4, 9, 50), "y": np.linspace(42, 51, 50)}))
    e, n = reproject("x", "y", 4326, 2154)
    lon, lat = reproject("e", "n", 2154, 4326)
    back = df.select("x", "y", e.alias("e"), n.alias("n")).select("x", "y", lon.alias("lon"), lat.alias("lat")).toPandas()
    assert np.allclose(back["x"], back["lon"], atol=1e-10) and np.allclose(back["y"], back["lat"], atol=1e-10)


ALPS = [(1, 983000.0, 6547000.0, 986000.0, 6550000.0)]


def test_same_crs_in_practice(spark):
    alps = spark.createDataFrame(ALPS, "id int, minx double, miny double, maxx double, maxy double")
    lambert = known_parameters(2154)
    assert K.same_crs_in_practice(alps, known_parameters(LAMBERT_WGS84), lambert).first()["same"]
    assert not K.same_crs_in_practice(alps, known_parameters(4326), lambert).first()["same"]
    assert not K.same_crs_in_practice(alps, crs_parameters(F.lit("LOCAL_CS")), lambert).first()["same"]


CONE_WKT2 = (
    'PROJCRS["c",BASEGEOGCRS["g",DATUM["d",ELLIPSOID["GRS 1980",6378137,298.257222101]]],CONVERSION["l",'
    'METHOD["Lambert Conic Conformal (2SP)",ID["EPSG",9802]],PARAMETER["Latitude of false origin",46.5],'
    'PARAMETER["Longitude of false origin",3],PARAMETER["Latitude of 1st standard parallel",49],'
    'PARAMETER["Latitude of 2nd standard parallel",44],PARAMETER["Easting at false origin",700000],'
    'PARAMETER["Northing at false origin",6600000]],CS[Cartesian,2],LENGTHUNIT["metre",1]]'
)


def test_crs_texts_as_columns(spark):
    """Texts of three kinds give the parameters of one cone; what is not understood gives null."""
    texts = ["EPSG:2154", "EPSG:2154+5720", CONE_WKT2, LAMBERT_PROJ]
    odd = [CONE_WKT2.replace('"metre",1', '"US survey foot",0.3048'), "+proj=utm +zone=31 +ellps=GRS80", "", None, CONE_WKT2.replace("44", "x")]
    rows = spark.createDataFrame([(t,) for t in texts + odd], "t string").select(crs_parameters("t").alias("p")).collect()
    for r in rows[:4]:
        assert not r.p.geographic and (r.p.lat0, r.p.lon0, r.p.lat1, r.p.lat2, r.p.x0, r.p.y0) == (46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0)
    assert [r.p for r in rows[4:]] == [None] * 5
    box = F.struct(*(F.lit(v).alias(k) for k, v in zip(("minx", "miny", "maxx", "maxy"), ALPS[0][1:])))
    pairs = [(a, b) for a in texts for b in texts]
    same = spark.createDataFrame(pairs, "a string, b string").select(same_crs("a", "b", box).alias("same")).collect()
    assert all(r.same for r in same)
    moved = LAMBERT_PROJ.replace("x_0=700000", "x_0=700000.002")
    out = spark.createDataFrame([(moved, "EPSG:2154"), ("odd", "odd"), ("odd", "EPSG:2154"), (None, "EPSG:2154")], "a string, b string")
    assert [r.same for r in out.select(same_crs("a", "b", box).alias("same")).collect()] == [False, True, False, False]


def test_projection_by_row_is_the_fixed_one(spark):
    p = known_parameters(2154)
    df = spark.createDataFrame([(6.8, 46.05), (2.0, 43.0)], "lon double, lat double")
    x, y = to_metres(F.col("lon"), F.col("lat"), p, cone(p))
    fx, fy = reproject("lon", "lat", 4171, 2154)
    lon, lat = to_degrees(F.col("x"), F.col("y"), p, cone(p))
    out = df.select("lon", "lat", x.alias("x"), y.alias("y"), fx.alias("fx"), fy.alias("fy")).select("*", lon.alias("lon2"), lat.alias("lat2")).toPandas()
    assert np.allclose(out["x"], out["fx"], atol=1e-6) and np.allclose(out["y"], out["fy"], atol=1e-6)
    assert np.allclose(out["lon"], out["lon2"], atol=1e-10) and np.allclose(out["lat"], out["lat2"], atol=1e-10)


def test_input_rules(spark):
    rows = [("s1", "ortho.TIF", 3, "byte", None), ("s1", "dem.tiff", 1, "float", None), ("s1", "grey.tif", 1, "byte", None),
            ("s1", "x.copc.laz", 0, None, None), ("s2", "a.tif", 3, "byte", None), ("s2", "b.tif", 4, "byte", None),
            ("s2", "c.laz", 0, None, None), ("s3", "h.tif", 1, "float", "height"), ("s3", "d.las", 0, None, None)]
    df = spark.createDataFrame(rows, "scene string, path string, bands int, dtype string, role string")
    kinds = {r["path"]: r["kind"] for r in K.classify_inputs(df).collect()}
    assert [kinds[p] for p in ("ortho.TIF", "dem.tiff", "grey.tif", "x.copc.laz", "c.laz")] == ["orthophoto", "dem", "dem", "tiled_cloud", "cloud"]
    errors = {(r["scene"], r["error"]) for r in K.input_errors(K.classify_inputs(df), ["scene"]).collect()}
    assert errors == {("s2", "several orthophotos"), ("s3", "height model without terrain")}


def test_screen_thinning_is_stable(spark):
    rng = np.random.default_rng(12)
    pts = pd.DataFrame(rng.random((2000, 3)), columns=["gx", "gy", "gz"]).assign(file_id=1, density=2000.0)
    views = spark.createDataFrame([(1, 0.5, 3.0, 0.5, 0.0, 1.5)], "file_id int, ex double, ey double, ez double, yaw double, pitch double")
    df = spark.createDataFrame(pts)
    few = L.screen_thin(df, views, viewport_h=40.0)
    n = few.count()
    assert 0 < n < 2000
    assert L.screen_thin(df.repartition(5), views, viewport_h=40.0).count() == n
    assert L.screen_thin(df, views, viewport_h=4000.0).count() == 2000
    assert few.where(F.col("depth_in_view") <= 0).count() == 0
