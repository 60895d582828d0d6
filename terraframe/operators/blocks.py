"""Block form of rasters: the shuffle unit of every neighbourhood operator.

A pixel table is dense: one row per (raster_id, row, col), with null where
the value is unknown. ``to_blocks`` packs it into square blocks of arrays
with a halo of neighbours, so that an operator which looks a few pixels
around itself needs one shuffle of the raster and no self-join. The arrays
are read by position inside generated code.

A block is bounded by its size (64 + halo pixels a side), whatever the size
of the raster, so a huge raster is many blocks and never one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
BLOCK_COLUMNS = ("row0", "col0", "bw", "bh")


def pack(
    spread: DataFrame, keys: list[str], values: list[str], carried: list[str] | None = None
) -> DataFrame:
    """Pixels grouped into row-major arrays; a missing pixel is an error, not a shift.

    ``carried`` are columns that are the same for all pixels of a block.
    """
    carried = carried or []
    packed = spread.groupBy(*keys).agg(
        F.min("row").alias("row0"),
        F.min("col").alias("col0"),
        F.expr("max(col) - min(col) + 1").alias("bw"),
        F.expr("max(row) - min(row) + 1").alias("bh"),
        F.sort_array(F.collect_list(F.struct("row", "col", *values))).alias("__px"),
        *(F.first(k).alias(k) for k in carried),
    )
    return packed.selectExpr(
        *keys,
        "row0",
        "col0",
        "CASE WHEN size(__px) = bw * bh THEN bw"
        " ELSE cast(raise_error('pixel table is not dense or has duplicates') AS int) END AS bw",
        "bh",
        *(f"__px.{v} AS {v}" for v in values),
        *carried,
    )


def to_blocks(
    pixels: DataFrame, values: list[str], size: int = BLOCK, before: int = 0, after: int = 1
) -> DataFrame:
    """Pixel table to (raster_id, brow, bcol, row0, col0, bw, bh, one array per value).

    Block (brow, bcol) holds rows ``brow*size - before`` to
    ``brow*size + size - 1 + after``, columns alike, cut at the raster's
    edge, in row-major order.
    """

    def blocks_of(index: str) -> str:
        first = f"cast(greatest(floor(({index} - {after}) / {size}), 0) AS int)"
        return f"explode(sequence({first}, cast(floor(({index} + {before}) / {size}) AS int)))"

    spread = (
        pixels.select("raster_id", "row", "col", *values)
        .selectExpr("*", f"{blocks_of('row')} AS brow")
        .selectExpr("*", f"{blocks_of('col')} AS bcol")
    )
    return pack(spread, ["raster_id", "brow", "bcol"], values)


def core_pixels(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per pixel of each block's core (halo left out), block columns kept.

    Adds row, col and ``pos``, the pixel's position in the block's arrays.
    """

    def core(index: str, first: str, count: str, block: str) -> str:
        low = f"greatest({first}, {block} * {size})"
        high = f"least({first} + {count} - 1, {block} * {size} + {size - 1})"
        return f"explode(sequence({low}, {high})) AS {index}"

    # A block made of nothing but a neighbour's halo has no core.
    real = blocks.where(f"brow * {size} < row0 + bh AND bcol * {size} < col0 + bw")
    return (
        real.selectExpr("*", core("row", "row0", "bh", "brow"))
        .selectExpr("*", core("col", "col0", "bw", "bcol"))
        .selectExpr("*", "(row - row0) * bw + col - col0 AS pos")
    )


def join_blocks(
    targets: DataFrame, blocks: DataFrame, row: str, column: str, size: int = BLOCK
) -> DataFrame:
    """Attach to each target the block whose core holds pixel (row, column); adds ``pos``.

    The target is shuffled once and the raster once per block. Targets off
    the raster keep their own block number, so they spread over partitions
    instead of meeting in one null key; they get null block columns. Always by
    sort-merge: Spark takes a generated grid for as small as the catalog it
    comes from and would broadcast its blocks through the driver.
    """
    keyed = targets.selectExpr(
        "*",
        f"cast(floor({row} / {size}) AS int) AS brow",
        f"cast(floor({column} / {size}) AS int) AS bcol",
    )
    joined = keyed.join(blocks.hint("merge"), ["raster_id", "brow", "bcol"], "left").drop("brow", "bcol")
    return joined.selectExpr("*", f"({row} - row0) * bw + {column} - col0 AS pos")
