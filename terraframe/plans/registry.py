"""Named queries: a Spark plan and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.plans.collection import Collection


@dataclass(frozen=True)
class Query:
    run: Callable[[Collection], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[Collection], DataFrame]):
        REGISTRY[name] = Query(run, sql)
        return run

    return add


def fixed(value: Column | str) -> Column:
    """Six decimals as an integer: comparable across engines."""
    c = F.col(value) if isinstance(value, str) else value
    return F.floor(c * 1e6 + 0.5).cast("long")


def fixed_as(**columns: Column | str) -> list[Column]:
    return [fixed(c).alias(k) for k, c in columns.items()]


def load_all() -> dict[str, Query]:
    from terraframe.plans import (  # noqa: F401
        catalog_queries,
        point_queries,
        quadtree_queries,
        raster_queries,
        source_queries,
        stream_queries,
        view_queries,
    )

    return REGISTRY
