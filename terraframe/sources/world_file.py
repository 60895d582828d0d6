"""World files: six-line text georeferences in pixel-centre convention."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terraframe.sources.files import Bundle, Ranges, bundles, list_files

# Order of the affine's terms in the file; bytes of small files a task reads.
LINES = ("a", "d", "b", "e", "c", "f")
TASK_BYTES = 32 << 20


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self) -> list[InputPartition]:
        files = [f for f in list_files(self.root, ("",)) if not f[0].rsplit("/", 1)[-1].startswith(("_", "."))]
        return bundles(files, TASK_BYTES, heads=True)

    def read(self, partition: Bundle) -> Iterator[tuple]:
        for path, _, _ in partition.slices:
            with Ranges(self.root, path) as data:
                yield path, data.read(0, data.size()).decode("utf-8", "replace")


class WorldFileSource(DataSource):
    """Whole texts of the files below a folder, many small files a task."""

    @classmethod
    def name(cls) -> str:
        return "worldfile"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_world_files(spark: SparkSession, path: str) -> DataFrame:
    """path and a..f of each world file below ``path``; malformed files give nulls."""
    spark.dataSource.register(WorldFileSource)
    text = spark.read.format("worldfile").load(path).select("path", F.split(F.trim("value"), r"\s+").alias("n"))
    terms = {k: F.expr(f"try_cast(get(n, {i}) AS double)") for i, k in enumerate(LINES)}
    return text.select("path", *(terms[k].alias(k) for k in "abcdef"))
