"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from terraframe.llm.storage import stored

#: A node with more than this share of all edges is joined in so many parts; there are fewer such nodes than the inverse share, twice.
HOT_SHARE, PARTS = 500, 16
#: Edges that a task connects by itself before the rounds begin.
TASK_EDGES = 200_000


def _with_least(wide: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """``wide`` (``a``, ``b``) with ``m`` of its ``a``; ``least``: ``a, m, n``. Rows of a hot ``a`` go to several tasks."""
    hot = least.where(F.col("n") > edges / HOT_SHARE).select("a", F.lit(PARTS).alias("parts"))
    left = wide.join(F.broadcast(hot), "a", "left")
    left = left.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(0).cast("int"))
    parts = F.when(F.col("n") > edges / HOT_SHARE, PARTS).otherwise(1)
    right = least.select("a", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return left.drop("parts").join(right, ["a", "part"]).drop("part")


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _marked(edges: DataFrame, parts: int | None) -> tuple[DataFrame, tuple]:
    """``edges``, written, and their number and the sum of their hashes, found while writing."""
    seen = Observation()
    total = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
    kept = stored(edges.observe(seen, F.count("*").alias("n"), total.alias("sum")), parts)
    return kept, (seen.get["n"], seen.get["sum"])


def _forest(edges: DataFrame) -> DataFrame:
    """For each task's edges those of their components: from the smallest node (``a``) to every other one (``b``)."""

    schema = edges.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q = top(a), top(b)
                if p != q:
                    above[max(p, q)] = min(p, q)
        pairs = [(top(x), x) for x in list(above)]
        pairs = [x for x in pairs if x[0] != x[1]]
        types = to_arrow_schema(schema).types
        for first in range(0, len(pairs), 10_000):
            a, b = zip(*pairs[first : first + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((a, b), types, strict=True)], names=["a", "b"])

    return edges.mapInArrow(run, schema)


def components(edges: DataFrame, parts: int | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(``node``, ``root``) of each node of ``edges`` (``a``, ``b``); the root is the smallest node it can reach.

    First each task connects ``task_edges`` of the edges by itself and hands on
    a star for each component it finds; if one task had them all, that is the
    result. Then every node is hung under its smallest neighbour, alternately with its
    larger and its smaller neighbours, until nothing changes: a number of
    rounds in the order of the square of the logarithm of the longest path.
    Minima are aggregates and hot nodes meet them in joins that adaptive
    execution can split; no group is collected. Each round is written to the
    shared folder, in ``parts`` files at most. Loops and repeated edges do no harm; nulls are ignored.
    """
    now, mark = _marked(edges.where("a < b").union(edges.where("a > b").select("b", "a")).toDF("a", "b").distinct(), parts)
    tasks = -(-mark[0] // task_edges)
    if tasks:
        now, mark = _marked(_forest(now.coalesce(1) if tasks == 1 else now.repartition(tasks)), parts)
    while tasks > 1:
        # large star: neighbours above a node move to its smallest neighbour
        wide = _both(now)
        least = wide.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        least = least.select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(wide.where("b > a"), least, 2 * mark[0]).select(F.col("m").alias("a"), "b").distinct()
        # small star: a node and its neighbours below it move to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        down = large.join(least, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now, after = _marked(down.union(least.select(F.col("m").alias("a"), "b")).distinct(), parts)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)
