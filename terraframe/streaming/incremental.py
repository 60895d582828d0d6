"""Incremental tile statistics, thinning and view planning.

Bounds, grids and tiles are static tables known before the stream starts, so
every stream-static step is an equi-join and state is one row per tile or
cell: bounded by the grid, whatever the length of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terraframe.operators.lod import desired_resolution, refine_plan, views_tiles
from terraframe.operators.points import (
    TILES,
    first_in_cell,
    points_to_tiles,
    thin_cells,
    tile_stats,
)


def stream_tile_stats(points: DataFrame, bounds: DataFrame, n: int = TILES) -> DataFrame:
    """Tile counts and ranges kept current as points arrive (update mode)."""
    return tile_stats(points_to_tiles(points, bounds, n))


def stream_thin(points: DataFrame, bounds: DataFrame, target: int) -> DataFrame:
    """First point of each cell by file index, whatever order points arrive in.

    Keeping the first *arrived* (``dropDuplicates``) would give another
    answer whenever files arrive out of order.
    """
    return first_in_cell(thin_cells(points, bounds, target), ["file_id", "cx", "cy"])


def stream_refine(
    views: DataFrame, tiles: DataFrame, fov_deg: float = 55.0, viewport_h: float = 900.0
) -> DataFrame:
    """Refinement requests for a stream of views against a static tile table; stateless."""
    wanted = desired_resolution(views_tiles(views, tiles, fov_deg, viewport_h), fov_deg, viewport_h)
    return refine_plan(wanted)


def run_available(df: DataFrame, sink: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Process everything available now into a Parquet folder.

    append: new rows as they are. update: the rows that a batch changed, in a
    folder ``batch=<number>`` of its own, so a batch that is run again after a
    failure replaces itself; :func:`latest` gives the current table.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", sink).start()
    else:
        query = writer.foreachBatch(
            lambda rows, number: rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        ).start()
    query.awaitTermination()
    return query


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key of what :func:`run_available` wrote in update mode."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return newest.select(*keys, "row.*")
