"""Joining big tables to their catalog: by broadcast where its size is known and small, else salted.

A catalog's size is never guessed. What is not already a plain scan of stored
files is written to the shared folder first, and the size of the files decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.session import stored

SALTS = 64
#: Bytes (Parquet) of a catalog that is sent to every executor.
BROADCAST_BYTES = 4 << 20

_PLAIN = {"LogicalRelation", "RelationV2", "DataSourceV2ScanRelation", "LocalRelation", "Project", "Filter", "OneRowRelation"}


def _is_plain(df: DataFrame) -> bool:
    """Whether the plan only reads files (or a literal table), so that Spark's size is that of the files."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName().split()[0]
        if name not in _PLAIN and not name.startswith(("Relation", "LogicalRelation", "Scan")):
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def known(catalog: DataFrame) -> DataFrame:
    """``catalog`` as a table of known size: itself if it is stored, else written once."""
    if catalog.isStreaming or _is_plain(catalog):
        return catalog
    return stored(catalog)


def size_of(catalog: DataFrame) -> int:
    """Bytes of a catalog that ``known`` returned."""
    return int(str(catalog._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(catalog: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Ask for a broadcast of a catalog, but only after its size has been checked."""
    catalog = known(catalog)
    return F.broadcast(catalog) if size_of(catalog) <= limit else catalog


def join_catalog(df: DataFrame, catalog: DataFrame, key: str, spread_by: list[str], limit: int = BROADCAST_BYTES, how: str = "inner") -> DataFrame:
    """Rows with the catalog row of their ``key``; rows without one are left out, or kept with ``how`` "left".

    A catalog within ``limit`` bytes is broadcast and the rows are not
    shuffled. A larger one is joined on the key and a salt taken from
    ``spread_by`` by a sort-merge join, which has no build side: a key's rows
    go to ``SALTS`` partitions, so one file or raster with a large share of
    all rows does not end up in one task; and a later aggregation within the
    key cannot take over that partitioning.
    """
    catalog = known(catalog)
    if not catalog.isStreaming and size_of(catalog) <= limit:
        return df.join(F.broadcast(catalog), key, how)
    salted = df.withColumn("__salt", F.pmod(F.hash(*spread_by), F.lit(SALTS)))
    copies = catalog.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [key, "__salt"], how).drop("__salt")
