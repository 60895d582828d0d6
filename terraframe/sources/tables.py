"""Parquet tables of points, rasters and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.functions.rules import depth_at_resolution
from terraframe.operators.lookup import sized
from terraframe.session import stored


def write_tables(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str]) -> None:
    """Write partitioned, and sorted so that row-group statistics can skip data.

    Rows are range-partitioned by the layout and sort keys, which splits a hot
    partition over several files and tasks instead of one.
    """
    keys = [*partition_by, *sort_by]
    (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def tile_number(gx: Column, gy: Column, n: int = 8) -> Column:
    """One number a tile of an n x n grid, row by row."""
    return (gy * n + gx).cast("int")


def write_lod_points(points: DataFrame, path: str, n: int = 8) -> None:
    """Multi-resolution points (with ``depth, gx, gy``): one folder per depth and tile number, sorted by cloud."""
    tiled = points.withColumn("tile", tile_number(F.col("gx"), F.col("gy"), n))
    write_tables(tiled, path, ["depth", "tile"], ["file_id", "file_idx"])


def read_lod_points(
    spark: SparkSession, path: str, spacing: float, max_depth: int, resolution: float | Column
) -> DataFrame:
    """Points fine enough for a resolution; coarser folders only are scanned."""
    wanted = depth_at_resolution(F.lit(spacing), F.lit(max_depth), resolution)
    return spark.read.parquet(path).where(F.col("depth") <= wanted)


def read_plan(spark: SparkSession, path: str, plan: DataFrame, n: int = 8) -> DataFrame:
    """Points of a table by ``write_lod_points`` that a plan asks for; all columns of both.

    plan: ``file_id, gx, gy`` and ``upto``, the deepest level wanted; one row
    a tile and whatever else asks for it (a view, say). The plan is written
    and, within a checked size, broadcast; Spark then prunes the table's
    folders by it while it runs (dynamic partition pruning), so that depths
    and tiles nobody wants are not read. Row groups are skipped by cloud.
    """
    levels = plan.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("upto").cast("int"))))
    asked = levels.withColumn("tile", tile_number(F.col("gx"), F.col("gy"), n)).drop("gx", "gy", "upto")
    # Spark prunes only by a side that is filtered; the comparison always holds
    asked = sized(stored(asked).where(F.col("depth") >= 0))
    return spark.read.parquet(path).join(asked, ["depth", "tile", "file_id"])
