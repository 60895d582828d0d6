"""Streaming queries: the events table replayed as a stream of points and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraframe.operators import lod as L
from terraframe.operators.points import cloud_bounds
from terraframe.plans.collection import Collection
from terraframe.plans.fixture_files import scratch
from terraframe.plans.registry import fixed_as, query
from terraframe.plans.sql import fixed as q, with_sql
from terraframe.plans.view_queries import _CTE, FOV, HEIGHT
from terraframe.streaming.incremental import latest, run_available, stream_refine, stream_thin, stream_tile_stats

_EVENTS = """
 SELECT event_id AS file_idx, user_id % 16 AS file_id, (event_id*7 % 997)*0.25e0 AS x, (user_id*13 % 499)*0.5e0 AS y,
  value AS z FROM events"""
_EVENT_BOUNDS = """SELECT file_id, count(*) AS point_count, min(x) AS minx, min(y) AS miny, max(x) AS maxx,
  max(y) AS maxy FROM ev GROUP BY file_id"""
TARGET = 100


def as_points(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("file_idx"),
        (F.col("user_id") % 16).alias("file_id"),
        ((F.col("event_id") * 7 % 997) * F.lit(0.25)).alias("x"),
        ((F.col("user_id") * 13 % 499) * F.lit(0.5)).alias("y"),
        F.col("value").alias("z"),
    )


def replay(c: Collection, table: str, key: str, batches: int = 4) -> DataFrame:
    """A table as a stream of a few micro-batches with many files each, last keys first in each file."""
    folder = scratch(c.spark, "arrivals")
    files = int(c.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = c.table(table)
    rows.repartition(files, key).sortWithinPartitions(F.col(key).desc()).write.mode("overwrite").parquet(folder)
    per_batch = max(1, -(-files // batches))
    return c.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def finished(c: Collection, stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there and give its final table; with ``keys`` by upserts, else by appending."""
    checkpoint, sink = scratch(c.spark, "stream"), scratch(c.spark, "results")
    run_available(stream, sink, "update" if keys else "append", checkpoint)
    if not keys:
        return c.spark.read.schema(stream.schema).parquet(sink)
    updates = c.spark.read.option("basePath", sink).schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())]))
    return latest(updates.parquet(sink), keys)


def _event_tile(v: str) -> str:
    w = f"((b.max{v} - b.min{v})/8e0)"
    g = f"least(7, greatest(0, floor((e.{v} - b.min{v})/{w})))"
    return (
        f"CAST(CASE WHEN {g} > 0 AND e.{v} < b.min{v} + {g}*{w} THEN {g} - 1 "
        f"WHEN {g} < 7 AND e.{v} >= b.min{v} + ({g}+1)*{w} THEN {g} + 1 ELSE {g} END AS INTEGER)"
    )


@query(
    "stream_ingest",
    with_sql("ev", "evb", extra={"ev": _EVENTS, "evb": _EVENT_BOUNDS.replace("FROM ev ", "FROM ev ")})
    + f"""SELECT file_id, gx, gy, count(*) AS point_count, {q('min(z)')} AS minz, {q('max(z)')} AS maxz FROM (
      SELECT e.file_id, e.z, {_event_tile('x')} AS gx, {_event_tile('y')} AS gy FROM ev e JOIN evb b USING (file_id))
      GROUP BY ALL""",
)
def _(c: Collection):
    bounds = cloud_bounds(as_points(c.table("events")))
    stats = stream_tile_stats(as_points(replay(c, "events", "event_id")), bounds)
    done = finished(c, stats, ["file_id", "gx", "gy"])
    return done.select("file_id", "gx", "gy", "point_count", *fixed_as(minz="minz", maxz="maxz"))


_EV_GRID = f"""
 SELECT file_id, minx, miny, thin, nx, ny, greatest((maxx-minx)/nx, (maxy-miny)/ny, 1e-9) AS cell FROM (
  SELECT *, greatest(1, CAST(floor((maxx-minx)/c0) AS BIGINT) + 1) AS nx,
   greatest(1, CAST(floor((maxy-miny)/c0) AS BIGINT) + 1) AS ny FROM (
   SELECT *, point_count > {TARGET} AS thin,
    greatest(sqrt(greatest((maxx-minx)*(maxy-miny), 1e-12)/{TARGET}e0), 1e-9) AS c0 FROM evb))"""


@query(
    "stream_thin",
    with_sql("ev", "evgrid", extra={"ev": _EVENTS, "evb": _EVENT_BOUNDS, "evgrid": _EV_GRID})
    + f"""SELECT e.file_id, e.file_idx, {q('e.x')} AS x, {q('e.y')} AS y, {q('e.z')} AS z FROM ev e JOIN (
      SELECT file_id, min(file_idx) AS file_idx FROM (
       SELECT e.file_id, file_idx, CASE WHEN thin THEN greatest(0, least(nx-1, floor((x-g.minx)/cell))) ELSE file_idx END AS cx,
        CASE WHEN thin THEN greatest(0, least(ny-1, floor((y-g.miny)/cell))) ELSE -1 END AS cy
       FROM ev e JOIN evgrid g USING (file_id)) GROUP BY file_id, cx, cy) k USING (file_id, file_idx)""",
)
def _(c: Collection):
    """Points arrive last first; the kept ones are still the first by index."""
    bounds = cloud_bounds(as_points(c.table("events")))
    kept = stream_thin(as_points(replay(c, "events", "event_id")), bounds, TARGET)
    done = finished(c, kept, ["file_id", "cx", "cy"])
    return done.select("file_id", "file_idx", *fixed_as(x="x", y="y", z="z"))


@query(
    "stream_refine",
    with_sql("wanted", extra=_CTE)
    + """SELECT view_id, file_id, gx, gy FROM wanted
      WHERE desired > 0 AND loaded > desired*1.5e0""",
)
def _(c: Collection):
    """Views arrive as a stream; the tiles are a table."""
    tiles_at = scratch(c.spark, "tile-table")
    L.with_coarse_resolution(c.scene_tiles).write.mode("overwrite").parquet(tiles_at)
    tiles = c.spark.read.parquet(tiles_at)
    views_at = scratch(c.spark, "view-arrivals")
    c.views.select("view_id", "ex", "ey", "ez").repartition(3, "view_id").write.mode("overwrite").parquet(views_at)
    views = c.spark.readStream.schema("view_id bigint, ex double, ey double, ez double").option(
        "maxFilesPerTrigger", 1
    ).parquet(views_at)
    plan = stream_refine(views, tiles, FOV, HEIGHT)
    return finished(c, plan.select("view_id", "file_id", "gx", "gy"))
