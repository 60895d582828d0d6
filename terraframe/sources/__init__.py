"""Readers and writers."""

from terraframe.sources.block_table import read_root_blocks, write_root_blocks
from terraframe.sources.geotiff import GeoTiffSource
from terraframe.sources.las import LasSource
from terraframe.sources.tables import read_lod_points, read_plan, write_lod_points, write_tables
from terraframe.sources.world_file import read_world_files


def register(spark) -> None:
    """Make the ``las`` and ``geotiff`` formats known to a session."""
    spark.dataSource.register(LasSource)
    spark.dataSource.register(GeoTiffSource)


__all__ = [
    "GeoTiffSource",
    "LasSource",
    "read_lod_points",
    "read_plan",
    "read_root_blocks",
    "read_world_files",
    "register",
    "write_lod_points",
    "write_root_blocks",
    "write_tables",
]
