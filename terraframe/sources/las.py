"""Uncompressed LAS 1.0-1.4 files as a Spark data source.

``spark.read.format("las").load(folder)`` gives one row per point;
``option("header_only", "true")`` one row per file. Records have a fixed
length, so a file is cut into byte ranges that are read and decoded
independently, each with one NumPy structured type.

Layout: ASPRS LAS specification 1.4 R15.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terraframe.functions.rules import COLOUR_OFFSET, MIN_RECORD_LENGTH
from terraframe.sources.files import Bundle, Ranges, bundles, list_files

POINTS = (
    "file_id string, file_idx bigint, x double, y double, z double, red int, green int, blue int"
)
HEADER = (
    "file_id string, version_minor int, format_id int, record_length int, point_count bigint, "
    "minx double, miny double, minz double, maxx double, maxy double, maxz double, "
    "wkt string, geokey_epsg int"
)
_BATCH = 65536
_LARGEST_RECORD = 64 << 20
_UNSET_KEYS = (0, 32767)


@dataclass(frozen=True)
class Header:
    minor: int
    format_id: int
    record_length: int
    point_offset: int
    point_count: int
    header_size: int
    vlr_count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    evlr_offset: int
    evlr_count: int


def parse_header(data: bytes) -> Header:
    if len(data) < 227 or data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = data[25]
    header_size, point_offset, vlr_count = struct.unpack_from("<HII", data, 94)
    format_id, record_length, count = struct.unpack_from("<BHI", data, 104)
    numbers = struct.unpack_from("<12d", data, 131)
    evlr_offset = evlr_count = 0
    if minor >= 4 and header_size >= 255 and len(data) >= 255:
        evlr_offset, evlr_count, wide = struct.unpack_from("<QIQ", data, 235)
        count = wide or count
    return Header(
        minor,
        format_id & 0x3F,
        record_length,
        point_offset,
        count,
        header_size,
        vlr_count,
        numbers[0:3],
        numbers[3:6],
        numbers[7:12:2],
        numbers[6:12:2],
        evlr_offset,
        evlr_count,
    )


def check_layout(format_id: int, record_length: int) -> int:
    """Byte offset of the colours (-1: none); an error for layouts that cannot be read."""
    if not 0 <= format_id <= 10:
        raise ValueError(f"unknown point format {format_id}")
    if record_length < MIN_RECORD_LENGTH[format_id]:
        raise ValueError(f"records of {record_length} bytes are too short for format {format_id}")
    return COLOUR_OFFSET[format_id]


def _projection_records(data: Ranges, header: Header) -> Iterator[tuple[int, bytes]]:
    """(record id, content) of the projection records, before and after the points."""
    for position, count, head in (
        (header.header_size, header.vlr_count, "<H16sHH"),
        (header.evlr_offset, header.evlr_count, "<H16sHQ"),
    ):
        extra = struct.calcsize(head) + 32
        for _ in range(count if position else 0):
            raw = data.read(position, extra)
            if len(raw) < extra:
                break
            _, user, record_id, length = struct.unpack_from(head, raw)
            if user.rstrip(b"\0") == b"LASF_Projection":
                if length >= _LARGEST_RECORD:
                    raise ValueError(f"projection record of {length} bytes")
                yield record_id, data.read(position + extra, length)
            position += extra + length


def _geokey_code(content: bytes) -> int:
    keys = struct.unpack(f"<{len(content) // 2}H", content[: len(content) // 2 * 2])
    entries = {keys[i]: keys[i + 1 : i + 4] for i in range(4, min(len(keys) - 3, 4 + 4 * keys[3]), 4)}
    for key in (3072, 2048):
        location, _, value = entries.get(key, (1, 0, 0))
        if location == 0 and value not in _UNSET_KEYS:
            return value
    return 0


def read_crs(data: Ranges, header: Header) -> tuple[str, int]:
    """WKT text and GeoTIFF key code; the WKT record counts first."""
    wkt, code = "", 0
    for record_id, content in _projection_records(data, header):
        if record_id == 2112 and not wkt:
            wkt = content.split(b"\0")[0].decode("utf-8", "replace")
        elif record_id == 34735 and not code and len(content) >= 8:
            code = _geokey_code(content)
    return (wkt or (f"EPSG:{code}" if code else "")), code


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.header_only = options.get("header_only", "false").lower() == "true"
        self.colours = options.get("colours", "true").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.root, (".las",))
        return bundles(files, self.split_bytes, heads=self.header_only)

    def read(self, partition: Bundle) -> Iterator:
        for path, part, parts in partition.slices:
            with Ranges(self.root, path) as data:
                header = parse_header(data.read(0, 375))
                yield from (
                    self._header(path, data, header)
                    if self.header_only
                    else self._points(path, part, parts, data, header)
                )

    def _header(self, path: str, data: Ranges, h: Header) -> Iterator[tuple]:
        wkt, code = read_crs(data, h)
        yield (path, h.minor, h.format_id, h.record_length, h.point_count, *h.low, *h.high, wkt, code)

    def _points(self, path: str, part: int, parts: int, data: Ranges, h: Header) -> Iterator:
        import numpy as np
        import pyarrow as pa

        colour = check_layout(h.format_id, h.record_length)
        fields = {"names": ["xyz"], "formats": ["<3i4"], "offsets": [0], "itemsize": h.record_length}
        if colour >= 0 and self.colours:
            fields["names"].append("rgb")
            fields["formats"].append("<3u2")
            fields["offsets"].append(colour)
        record = np.dtype(fields)
        first = h.point_count * part // parts
        last = h.point_count * (part + 1) // parts
        for start in range(first, last, _BATCH):
            n = min(_BATCH, last - start)
            raw = data.read(h.point_offset + start * h.record_length, n * h.record_length)
            if len(raw) != n * h.record_length:
                raise ValueError(f"{path} ends before its {h.point_count} points")
            rows = np.frombuffer(raw, dtype=record)
            axes = [rows["xyz"][:, k] * h.scale[k] + h.offset[k] for k in range(3)]
            if "rgb" in fields["names"]:
                colours = [pa.array(rows["rgb"][:, k].astype("i4")) for k in range(3)]
            else:
                colours = [pa.nulls(n, pa.int32())] * 3
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * n, pa.string()),
                    pa.array(np.arange(start, start + n, dtype="i8")),
                    *(pa.array(a) for a in axes),
                    *colours,
                ],
                names=["file_id", "file_idx", "x", "y", "z", "red", "green", "blue"],
            )


class LasSource(DataSource):
    """Options: header_only, colours (false: skip them), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return HEADER if self.options.get("header_only", "false").lower() == "true" else POINTS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
