"""Stored root blocks: the table form of rasters that quadtrees are built from.

One row a root cell (``raster_id, rx, ry``): position and size of the block
(``row0, col0, bw, bh``), row-major arrays ``v`` and ``filled``, and the raster's
geometry (``width, height, pw, ph, cw0, ch0, root_level, roots``). The layout
depends on the coarse grid and the span only, so one table serves every
tolerance and depth. It is ordinary Parquet, sorted by root inside its files:
a request for some rasters or roots skips row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraframe.operators.roots import COARSE, MAX_SPAN, ROOT, root_blocks


def write_root_blocks(pixels: DataFrame, catalog: DataFrame, path: str, coarse: int = COARSE, max_span: float = MAX_SPAN) -> DataFrame:
    """Write pixels (``v``, ``filled``) as root blocks to ``path`` and return the table as read back."""
    root_blocks(pixels, catalog, coarse, max_span).sortWithinPartitions(*ROOT).write.parquet(path)
    return read_root_blocks(pixels.sparkSession, path)


def read_root_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
