from __future__ import annotations

import struct

import numpy as np
import pytest

from terraframe.functions.crs import horizontal_epsg
from terraframe.functions.rules import colour_offset, valid_format
from terraframe.operators.raster import dem_pixels
from terraframe.plans.fixture_files import las_bytes, tiff_bytes
from terraframe.sources import read_lod_points, read_world_files, register, write_lod_points

XYZ = np.array([[991010.25, 6557020.5, 800.75], [991500.0, 6557500.0, 900.0], [991990.5, 6557980.25, 1000.5]])
RGB = np.array([[65535, 0, 0], [0, 65535, 0], [0, 0, 65535]])
COMPOUND = (
    'COMPD_CS["both",PROJCS["RGF93 / Lambert-93",GEOGCS["RGF93",AUTHORITY["EPSG","4171"]],'
    'AUTHORITY["EPSG","2154"]],VERT_CS["NGF-IGN69",AUTHORITY["EPSG","5720"]]]'
)


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    register(spark)


def las12():
    return las_bytes(XYZ, RGB, offset=(991000.0, 6557000.0, 0.0))


def las14(wkt: str) -> bytes:
    """LAS 1.4, format 7, 64-bit count, WKT in an extended record after the points."""
    base = las12()
    head = bytearray(base[:227].ljust(375, b"\0"))
    head[25] = 4
    struct.pack_into("<H", head, 94, 375)
    struct.pack_into("<II", head, 96, 375, 0)
    struct.pack_into("<BHI", head, 104, 7, 36, 0)
    points = b""
    for p, c in zip(XYZ, RGB):
        raw = np.floor((p - [991000.0, 6557000.0, 0.0]) / 0.01 + 0.5).astype("<i4").tobytes()
        points += raw + b"\0" * 18 + c.astype("<u2").tobytes()
    text = wkt.encode() + b"\0"
    evlr = struct.pack("<H16sHQ32s", 0, b"LASF_Projection", 2112, len(text), b"") + text
    struct.pack_into("<QIQ", head, 235, 375 + len(points), 1, 3)
    return bytes(head) + points + evlr


def save(folder, name, content):
    (folder / name).write_bytes(content)
    return str(folder)


@pytest.mark.parametrize("content", [las12(), las14(COMPOUND)], ids=["1.2", "1.4"])
def test_las(spark, tmp_path, content):
    folder = save(tmp_path, "t.las", content)
    head = spark.read.format("las").option("header_only", "true").load(folder)
    row = head.select("*", horizontal_epsg("wkt").alias("epsg")).first()
    assert (row["point_count"], row["epsg"]) == (3, 2154)
    assert (row["minx"], row["maxy"], row["minz"], row["maxz"]) == (991010.25, 6557980.25, 800.75, 1000.5)
    points = spark.read.format("las").load(folder).orderBy("file_idx").collect()
    assert np.allclose([[p["x"], p["y"], p["z"]] for p in points], XYZ, atol=0.02)
    assert [[p["red"], p["green"], p["blue"]] for p in points] == RGB.tolist()


def test_las_without_crs(spark, tmp_path):
    content = bytearray(las12())
    struct.pack_into("<I", content, 100, 0)
    head = spark.read.format("las").option("header_only", "true").load(save(tmp_path, "n.las", bytes(content)))
    row = head.select("wkt", horizontal_epsg("wkt").alias("epsg")).first()
    assert (row["wkt"], row["epsg"]) == ("", 0)


def test_las_is_split_by_byte_ranges(spark, tmp_path):
    rng = np.random.default_rng(4)
    xyz = np.round(rng.random((5000, 3)) * 100, 2)
    folder = save(tmp_path, "big.las", las_bytes(xyz, np.zeros((5000, 3), int)))
    points = spark.read.format("las").option("split_bytes", 20000).option("colours", "false").load(folder)
    assert points.rdd.getNumPartitions() == 7
    got = points.toPandas().sort_values("file_idx")
    assert got["file_idx"].tolist() == list(range(5000))
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), xyz) and got["red"].isna().all()


def test_bad_las_is_an_error(spark, tmp_path):
    content = bytearray(las12())
    content[104] = 11
    with pytest.raises(Exception, match="unknown point format 11"):
        spark.read.format("las").load(save(tmp_path, "bad.las", bytes(content))).collect()
    with pytest.raises(Exception, match="ends before"):
        spark.read.format("las").load(save(tmp_path / "..", "cut.las", las12()[:-10]) + "/cut.las").collect()


def test_record_layouts(spark):
    rows = [(2, 26), (3, 34), (6, 30), (0x80 | 7, 36), (2, 20), (11, 80)]
    df = spark.createDataFrame(rows, "f int, n int")
    got = [tuple(r) for r in df.select(valid_format("f", "n"), colour_offset("f")).collect()]
    assert got == [(True, 20), (True, 28), (True, -1), (True, 30), (False, 20), (False, None)]


def bands(*planes, kind="u1"):
    return [np.asarray(p, kind) for p in planes]


def test_geotiff_image(spark, tmp_path):
    i = np.arange(100).reshape(10, 10)
    content = tiff_bytes(bands(i, 2 * i, 255 - i), (1000.0, 2.0, 0.0, 5000.0, 0.0, -2.0))
    folder = save(tmp_path, "ortho.tif", content)
    c = spark.read.format("geotiff").option("header_only", "true").load(folder).first()
    assert (c["c"], c["f"], c["a"], c["e"], c["epsg"], c["bands"], c["dtype"]) == (1001.0, 4999.0, 2.0, -2.0, 2154, 3, "byte")
    p = spark.read.format("geotiff").load(folder).where("row = 3 AND col = 7").first()
    assert (p["band1"], p["band2"], p["band3"], p["band4"]) == (37.0, 74.0, 218.0, None)


def test_geotiff_nodata_and_missing_georeference(spark, tmp_path):
    gt = (0.0, 1.0, 0.0, 10.0, 0.0, -1.0)
    save(tmp_path, "a.tif", tiff_bytes(bands([[0, 5], [10, 15]], kind="<f4"), gt, 0.0))
    save(tmp_path, "b.tif", tiff_bytes(bands([[-9999, 1], [2, 3]], kind="<f4"), gt))
    folder = save(tmp_path, "c.tif", tiff_bytes(bands([[1, 2], [3, 4]], kind="<f4"), None))
    name = "substring(path, length(path) - 4, 1) AS raster_id"
    cat = spark.read.format("geotiff").option("header_only", "true").load(folder).selectExpr("*", name)
    raw = spark.read.format("geotiff").load(folder).selectExpr(name, "row", "col", "band1 AS v")
    got = {(r["raster_id"], r["row"], r["col"]): r["v"] for r in dem_pixels(raw, cat).collect()}
    assert got == {
        ("a", 0, 0): None, ("a", 0, 1): 5.0, ("a", 1, 0): 10.0, ("a", 1, 1): 15.0,
        ("b", 0, 0): None, ("b", 0, 1): 1.0, ("b", 1, 0): 2.0, ("b", 1, 1): 3.0,
    }


def test_geotiff_strips_are_shared_out(spark, tmp_path):
    z = np.arange(64 * 50).reshape(64, 50)
    folder = save(tmp_path, "s.tif", tiff_bytes(bands(z, kind="<f4"), (0.0, 1.0, 0.1, 0.0, 0.1, -1.0)))
    df = spark.read.format("geotiff").option("split_bytes", 3000).load(folder)
    assert df.rdd.getNumPartitions() > 3
    got = df.toPandas().sort_values(["row", "col"])["band1"].to_numpy().reshape(64, 50)
    assert np.array_equal(got, z)


def test_world_file(spark, tmp_path):
    folder = save(tmp_path, "noref.tfw", b"0.5\n0\n0\n-0.5\n200000.25\n6000000.75\n")
    r = read_world_files(spark, folder).first()
    assert [r[k] for k in "abcdef"] == [0.5, 0.0, 200000.25, 0.0, -0.5, 6000000.75]


def test_lod_table_prunes_depths(spark, tmp_path):
    rows = [("a", i, float(i), 0.0, 0.0, i % 3, 0, 0) for i in range(30)]
    schema = "file_id string, file_idx int, x double, y double, z double, depth int, gx int, gy int"
    write_lod_points(spark.createDataFrame(rows, schema), str(tmp_path / "lod"))
    found = read_lod_points(spark, str(tmp_path / "lod"), 10.0, 2, 5.0)
    assert found.count() == 20
    assert "PartitionFilters: [isnotnull(depth" in found._jdf.queryExecution().toString()


def test_small_files_share_a_task(spark, tmp_path):
    """A task a file took longer than reading it."""
    content = tiff_bytes(bands([[1, 2], [3, 4]], kind="<f4"), (0.0, 1.0, 0.0, 10.0, 0.0, -1.0))
    for k in range(40):
        save(tmp_path, f"{k}.tif", content)
        save(tmp_path, f"{k}.las", las12())
        save(tmp_path, f"{k}.tfw", f"{k}.5\n0\n0\n-1\n7\n8\n".encode())
    folder = str(tmp_path)
    for name, rows in (("geotiff", 160), ("las", 120)):
        heads = spark.read.format(name).option("header_only", "true").load(folder)
        assert heads.rdd.getNumPartitions() == 1 and heads.count() == 40
        whole = spark.read.format(name).load(folder)
        assert whole.rdd.getNumPartitions() == 1 and whole.count() == rows
        assert spark.read.format(name).option("split_bytes", 200).load(folder).count() == rows
    worlds = tmp_path / "w"
    worlds.mkdir()
    for k in range(700):
        save(worlds, f"{k}.tfw", f"{k}.5\n0\n0\n-1\n7\n8\n".encode())
    found = read_world_files(spark, str(worlds))
    assert found.rdd.getNumPartitions() == 2
    assert sorted(r["a"] for r in found.collect()) == [k + 0.5 for k in range(700)]
