"""Listing and byte-range reading on any file system Arrow knows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

# Fixed value: what opening a file counts for, in bytes read, when files are put together.
OPEN_BYTES = 64 << 10


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path[len("file:") :]
    return fs.LocalFileSystem(), path


def list_files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the matching files below a folder, sorted."""
    system, where = resolve(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.File:
        return [(where, info.size)]
    found = system.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted(
        (f.path, f.size)
        for f in found
        if f.type == fs.FileType.File and f.path.lower().endswith(suffixes)
    )


def split_count(size: int, split_bytes: int) -> int:
    return max(1, -(-size // split_bytes))


@dataclass
class Bundle(InputPartition):
    """One task's share: slices (path, part, parts) of files."""

    slices: list[tuple[str, int, int]]


def bundles(files: list[tuple[str, int]], split_bytes: int, heads: bool = False) -> list[InputPartition]:
    """Large files cut, small ones put together, to about ``split_bytes`` a task; ``heads``: little of each file is read."""
    found: list[InputPartition] = []
    together, weight = [], 0
    for path, size in files:
        n = 1 if heads else split_count(size, split_bytes)
        if n > 1:
            found += [Bundle([(path, k, n)]) for k in range(n)]
            continue
        cost = OPEN_BYTES + (0 if heads else size)
        if together and weight + cost > split_bytes:
            found.append(Bundle(together))
            together, weight = [], 0
        together.append((path, 0, 1))
        weight += cost
    return [*found, Bundle(together)] if together else found


def merged(batches: Iterator, rows: int = 1 << 16) -> Iterator:
    """The same rows in record batches of about ``rows``."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Ranges:
    """Random access to one file."""

    def __init__(self, root: str, path: str):
        system, _ = resolve(root)
        self._file = system.open_input_file(path)

    def read(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset) if length > 0 else b""

    def size(self) -> int:
        return self._file.size()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()
