"""The flagship composition: thin, tile and describe every cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.operators.points import grid_thin, point_spacing, points_to_tiles, tile_pca
from terraframe.plans.collection import Collection


def tile_report(c: Collection, target: int = 300) -> DataFrame:
    """Tiles of the thinned clouds with count, height range, extents and spacing."""
    thinned = grid_thin(c.points, c.bounds, target)
    tiles = tile_pca(points_to_tiles(thinned, c.bounds))
    return tiles.select(
        "file_id",
        "gx",
        "gy",
        "point_count",
        "minz",
        "maxz",
        "e1",
        "e2",
        "e3",
        point_spacing(F.col("e1"), F.col("e2"), F.col("point_count")).alias("spacing"),
    )
