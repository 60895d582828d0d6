"""Uncompressed GeoTIFF rasters as a Spark data source.

``spark.read.format("geotiff").load(folder)`` gives one row per pixel with up
to four bands; ``option("header_only", "true")`` the raster catalog. Strips
(or tiles) of a file are shared out to partitions and decoded with NumPy.

Layout: TIFF 6.0 and OGC GeoTIFF 1.1. BigTIFF and compression are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terraframe.sources.files import Bundle, Ranges, bundles, list_files, merged

PIXELS = "path string, row int, col int, band1 double, band2 double, band3 double, band4 double"
CATALOG = (
    "path string, width int, height int, bands int, dtype string, has_geo boolean, "
    "gt0 double, gt1 double, gt2 double, gt3 double, gt4 double, gt5 double, "
    "a double, b double, c double, d double, e double, f double, "
    "nodata double, has_alpha boolean, epsg int"
)
# TIFF field types (code: struct letter and size) and tags.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION = 256, 257, 258, 259
_STRIP_OFFSETS, _SAMPLES, _ROWS_PER_STRIP, _STRIP_COUNTS, _PLANAR = 273, 277, 278, 279, 284
_TILE_WIDTH, _TILE_LENGTH, _TILE_OFFSETS, _TILE_COUNTS = 322, 323, 324, 325
_EXTRA_SAMPLES, _SAMPLE_FORMAT = 338, 339
_PIXEL_SCALE, _TIEPOINT, _MATRIX, _GEO_KEYS, _NODATA = 33550, 33922, 34264, 34735, 42113
_PIXEL_IS_POINT = 2


def _tags(data: Ranges) -> tuple[str, dict[int, tuple]]:
    head = data.read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    start = struct.unpack(order + "I", head[4:8])[0]
    count = struct.unpack(order + "H", data.read(start, 2))[0]
    directory = data.read(start + 2, 12 * count)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", directory, 12 * i)
        letter = _TYPES.get(kind)
        if letter is None:
            continue
        layout = f"{order}{n}s" if letter == "s" else order + letter * n
        size = struct.calcsize(layout)
        inline = directory[12 * i + 8 : 12 * i + 12]
        raw = inline[:size] if size <= 4 else data.read(struct.unpack(order + "I", inline)[0], size)
        tags[tag] = struct.unpack(layout, raw)
    return order, tags


@dataclass(frozen=True)
class Layout:
    """What is needed to decode a raster's chunks."""

    order: str
    width: int
    height: int
    bands: int
    numpy_type: str
    chunk_w: int
    chunk_h: int
    offsets: tuple
    counts: tuple
    separate: bool
    tiled: bool
    tags: dict

    @property
    def across(self) -> int:
        return -(-self.width // self.chunk_w)

    @property
    def down(self) -> int:
        return -(-self.height // self.chunk_h)


def read_layout(data: Ranges) -> Layout:
    order, t = _tags(data)
    if t.get(_COMPRESSION, (1,))[0] != 1:
        raise ValueError("compressed GeoTIFF is not supported")
    width, height = t[_WIDTH][0], t[_HEIGHT][0]
    bits, fmt = t.get(_BITS, (1,))[0], t.get(_SAMPLE_FORMAT, (1,))[0]
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{bits}-bit samples are not supported")
    tiled = _TILE_OFFSETS in t
    return Layout(
        order,
        width,
        height,
        t.get(_SAMPLES, (1,))[0],
        f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[fmt] }{bits // 8}",
        t[_TILE_WIDTH][0] if tiled else width,
        t[_TILE_LENGTH][0] if tiled else min(height, t.get(_ROWS_PER_STRIP, (height,))[0]),
        t[_TILE_OFFSETS] if tiled else t[_STRIP_OFFSETS],
        t[_TILE_COUNTS] if tiled else t[_STRIP_COUNTS],
        t.get(_PLANAR, (1,))[0] == 2,
        tiled,
        t,
    )


def geotransform(tags: dict) -> tuple[float, ...] | None:
    """Corner-origin geotransform, or None."""
    keys = _geo_keys(tags)
    if _MATRIX in tags:
        m = tags[_MATRIX]
        gt = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif _PIXEL_SCALE in tags and _TIEPOINT in tags:
        (sx, sy), tie = tags[_PIXEL_SCALE][:2], tags[_TIEPOINT]
        gt = (tie[3] - tie[0] * sx, sx, 0.0, tie[4] + tie[1] * sy, 0.0, -sy)
    else:
        return None
    if keys.get(1025) == _PIXEL_IS_POINT:
        gt = (gt[0] - (gt[1] + gt[2]) / 2, gt[1], gt[2], gt[3] - (gt[4] + gt[5]) / 2, gt[4], gt[5])
    return None if gt == (0.0, 1.0, 0.0, 0.0, 0.0, 1.0) else gt


def _geo_keys(tags: dict) -> dict[int, int]:
    k = tags.get(_GEO_KEYS, (0, 0, 0, 0))
    return {k[i]: k[i + 3] for i in range(4, min(len(k) - 3, 4 + 4 * k[3]), 4) if k[i + 1] == 0}


def _catalog_row(path: str, lay: Layout) -> tuple:
    gt = geotransform(lay.tags)
    keys = _geo_keys(lay.tags)
    code = next((keys[k] for k in (3072, 2048) if keys.get(k, 32767) not in (0, 32767)), 0)
    nodata = lay.tags.get(_NODATA)
    text = nodata[0].split(b"\0")[0].strip() if nodata else b""
    affine: tuple = (None,) * 6
    if gt:
        affine = (
            gt[1], gt[2], gt[0] + gt[1] / 2 + gt[2] / 2,
            gt[4], gt[5], gt[3] + gt[4] / 2 + gt[5] / 2,
        )
    return (
        path,
        lay.width,
        lay.height,
        lay.bands,
        "byte" if lay.numpy_type[1:] == "u1" else {"u": "uint", "i": "int", "f": "float"}[lay.numpy_type[1]],
        gt is not None,
        *(gt or (None,) * 6),
        *affine,
        float(text) if text else None,
        bool({1, 2} & set(lay.tags.get(_EXTRA_SAMPLES, ()))),
        code,
    )


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.header_only = options.get("header_only", "false").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.root, (".tif", ".tiff"))
        return bundles(files, self.split_bytes, heads=self.header_only)

    def read(self, partition: Bundle) -> Iterator:
        found = (row for piece in partition.slices for row in self._file(*piece))
        return found if self.header_only else merged(found)

    def _file(self, path: str, part: int, parts: int) -> Iterator:
        with Ranges(self.root, path) as data:
            layout = read_layout(data)
            if self.header_only:
                yield _catalog_row(path, layout)
                return
            chunks = layout.across * layout.down
            for chunk in range(chunks * part // parts, chunks * (part + 1) // parts):
                yield self._chunk(path, data, layout, chunk)

    def _chunk(self, path: str, data: Ranges, lay: Layout, chunk: int):
        import numpy as np
        import pyarrow as pa

        row0 = chunk // lay.across * lay.chunk_h
        col0 = chunk % lay.across * lay.chunk_w
        h, w = min(lay.chunk_h, lay.height - row0), min(lay.chunk_w, lay.width - col0)
        stored_h = lay.chunk_h if lay.tiled else h
        kind = np.dtype(lay.numpy_type)

        def plane(index: int, samples: int):
            need = stored_h * lay.chunk_w * samples * kind.itemsize
            raw = data.read(lay.offsets[index], need)
            if len(raw) != need:
                raise ValueError(f"{path} ends inside chunk {index}")
            return np.frombuffer(raw, kind).reshape(stored_h, lay.chunk_w, samples)[:h, :w]

        if lay.bands > 4:
            raise ValueError(f"{path} has {lay.bands} bands; pixels of up to four are read")
        per_band = lay.across * lay.down
        if lay.separate:
            planes = [plane(b * per_band + chunk, 1)[:, :, 0] for b in range(lay.bands)]
        else:
            block = plane(chunk, lay.bands)
            planes = [block[:, :, b] for b in range(lay.bands)]
        n = h * w
        rows = np.repeat(np.arange(row0, row0 + h, dtype="i4"), w)
        cols = np.tile(np.arange(col0, col0 + w, dtype="i4"), h)
        bands = [pa.array(p.reshape(-1).astype("f8")) for p in planes]
        bands += [pa.nulls(n, pa.float64())] * (4 - len(bands))
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * n, pa.string()), pa.array(rows), pa.array(cols), *bands],
            names=["path", "row", "col", "band1", "band2", "band3", "band4"],
        )


class GeoTiffSource(DataSource):
    """Options: header_only, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return CATALOG if self.options.get("header_only", "false").lower() == "true" else PIXELS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
