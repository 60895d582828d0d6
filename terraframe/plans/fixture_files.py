"""LAS, GeoTIFF and world files written from DataFrames, as inputs for the readers."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.session import shared_dir, spread
from terraframe.sources.files import resolve


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder."""
    system, root = resolve(shared_dir(spark))
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    system.create_dir(path)
    return path


def las_bytes(
    xyz, rgb, scale=(0.01, 0.01, 0.01), offset=(0.0, 0.0, 0.0), epsg: int = 2154
) -> bytes:
    """A LAS 1.2 file, point format 2, with a GeoTIFF key record."""
    import numpy as np

    record = np.zeros(
        len(xyz),
        np.dtype({"names": ["p", "c"], "formats": ["<3i4", "<3u2"], "offsets": [0, 20], "itemsize": 26}),
    )
    record["p"] = np.floor((xyz - np.array(offset)) / np.array(scale) + 0.5).astype("i4")
    record["c"] = rgb
    stored = record["p"] * np.array(scale) + np.array(offset)
    low, high = stored.min(axis=0), stored.max(axis=0)
    keys = struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, epsg)
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"") + keys
    head = struct.pack("<4sHH16sBB32s32sHHHII", b"LASF", 0, 0, b"", 1, 2, b"", b"", 1, 2026, 227, 227 + len(vlr), 1)
    head += struct.pack("<BHI5I", 2, 26, len(xyz), len(xyz), 0, 0, 0, 0)
    head += struct.pack("<6d", *scale, *offset)
    head += struct.pack("<6d", high[0], low[0], high[1], low[1], high[2], low[2])
    return head + vlr + record.tobytes()


def tiff_bytes(
    planes: list, geotransform: tuple | None, nodata: float | None = None, epsg: int = 2154
) -> bytes:
    """An uncompressed single-strip-per-8-rows TIFF of equally typed 2-D arrays."""
    import numpy as np

    pixels = np.stack(planes, axis=-1)
    h, w, bands = pixels.shape
    fmt = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    rows = 8
    strips = [pixels[r : r + rows].tobytes() for r in range(0, h, rows)]
    tags: list[tuple[int, int, bytes, int]] = []

    def add(tag: int, code: str, *values) -> None:
        kind = {"H": 3, "I": 4, "d": 12}[code]
        tags.append((tag, kind, struct.pack(f"<{len(values)}{code}", *values), len(values)))

    add(256, "I", w)
    add(257, "I", h)
    add(258, "H", *([pixels.dtype.itemsize * 8] * bands))
    add(259, "H", 1)
    add(262, "H", 2 if bands >= 3 else 1)
    add(273, "I", *([0] * len(strips)))
    add(277, "H", bands)
    add(278, "I", rows)
    add(279, "I", *map(len, strips))
    add(339, "H", *([fmt] * bands))
    if geotransform:
        g = geotransform
        if g[2] == 0 and g[4] == 0:
            add(33550, "d", g[1], -g[5], 0.0)
            add(33922, "d", 0.0, 0.0, 0.0, g[0], g[3], 0.0)
        else:
            add(34264, "d", g[1], g[2], 0.0, g[0], g[4], g[5], 0.0, g[3], 0, 0, 0, 0, 0, 0, 0, 1)
        add(34735, "H", 1, 1, 0, 1, 3072, 0, 1, epsg)
    if nodata is not None:
        text = f"{nodata:.9g}".encode() + b"\0"
        tags.append((42113, 2, text, len(text)))
    tags.sort(key=lambda t: t[0])
    heap_start = 8 + 2 + 12 * len(tags) + 4
    heap, entries = b"", []
    for tag, kind, raw, count in tags:
        if len(raw) <= 4:
            entries.append([tag, kind, count, raw.ljust(4, b"\0")])
        else:
            entries.append([tag, kind, count, struct.pack("<I", heap_start + len(heap))])
            heap += raw + b"\0" * (len(raw) % 2)
    data_start = heap_start + len(heap)
    offsets, at = [], data_start
    for s in strips:
        offsets.append(at)
        at += len(s)
    packed = struct.pack(f"<{len(offsets)}I", *offsets)
    for e in entries:
        if e[0] == 273:
            if len(packed) <= 4:
                e[3] = packed.ljust(4, b"\0")
            else:
                where = struct.unpack("<I", e[3])[0] - heap_start
                heap = heap[:where] + packed + heap[where + len(packed) :]
    body = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    body += b"".join(struct.pack("<HHI", *e[:3]) + e[3] for e in entries) + struct.pack("<I", 0)
    return body + heap + b"".join(strips)


def _save(folder: str, name: str, content: bytes) -> None:
    system, where = resolve(folder)
    with system.open_output_stream(f"{where}/{name}") as out:
        out.write(content)


def write_las(points: DataFrame, folder: str) -> None:
    """One LAS file per Arrow batch of points."""

    def save(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            if len(batch):
                content = las_bytes(
                    batch[["x", "y", "z"]].to_numpy(), batch[["red", "green", "blue"]].to_numpy()
                )
                # A retried task overwrites: the name follows from the content.
                name = hashlib.sha1(content).hexdigest()
                _save(folder, f"{name}.las", content)
                yield pd.DataFrame({"n": [len(batch)]})

    points.select("x", "y", "z", "red", "green", "blue").mapInPandas(save, "n long").agg(
        F.sum("n")
    ).collect()


def write_geotiffs(blocks: DataFrame, catalog: DataFrame, folder: str) -> None:
    """One float GeoTIFF per raster that fits in a single block."""

    def save(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples():
                values = np.array([np.nan if v is None else v for v in r.v], "f8")
                plane = np.where(np.isnan(values), -9999.0, values).astype("<f4").reshape(r.bh, r.bw)
                gt = (r.c - r.a / 2, r.a, 0.0, r.f - r.e / 2, 0.0, r.e)
                _save(folder, f"dem-{r.raster_id}.tif", tiff_bytes([plane], gt, -9999.0))
            yield pd.DataFrame({"n": [len(batch)]})

    joined = blocks.join(catalog.select("raster_id", "a", "c", "e", "f"), "raster_id")
    joined.select("raster_id", "bw", "bh", "v", "a", "c", "e", "f").mapInPandas(save, "n long").agg(
        F.sum("n")
    ).collect()


def write_world_files(catalog: DataFrame, folder: str) -> None:
    """One world file per raster, named after it."""

    def save(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples():
                _save(folder, f"dem-{r.raster_id}.tfw", r.value.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    lines = F.concat_ws("\n", *(F.col(k).cast("string") for k in ("a", "d", "b", "e", "c", "f")))
    spread(catalog.select("raster_id", lines.alias("value"))).mapInPandas(save, "n long").agg(F.sum("n")).collect()
