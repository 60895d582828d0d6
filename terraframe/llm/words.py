"""Words of a whole Arrow text column as NumPy arrays.

Texts are read as one UTF-8 buffer, so a batch of documents costs a few
vector passes instead of one Python object per word. All tables below are
derived from a seed; nothing is kept between batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BYTE_HASH = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_HASH[65:91] = _BYTE_HASH[97:123]  # A-Z count as a-z
_ROLL = [np.uint64(int(x) | 1) for x in np.random.default_rng(7).integers(1, 1 << 62, 64)]

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Word ``i`` is ``buffer[starts[i]:ends[i]]``; document ``d`` has words ``bounds[d]:bounds[d+1]``."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """One 64-bit value per word, the same for words that differ only in the case of A-Z."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        size = self.ends - self.starts
        first = np.cumsum(size) - size
        place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)  # of each byte in its word
        powers = np.full(int(size.max()), _BASE, dtype=np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        value = powers[place]
        place += np.repeat(self.starts, size)
        value *= _BYTE_HASH[self.buffer[place]]
        return mixed(np.add.reduceat(value, first))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` values; runs may cross documents, the caller masks those."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out += hashes[i : i + n] * _ROLL[i]
    return mixed(out)


def sequence_hash(hashes: np.ndarray) -> int:
    """Of a whole short sequence; agrees with ``rolling`` for its own length."""
    return int(rolling(hashes, len(hashes))[0])


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of documents with about ``most`` bytes; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, raw, data = column.buffers()
    at = np.frombuffer(raw, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(buffer: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES) -> Words:
    """Maximal runs of bytes outside ``breaks``; a document's end ends its last word."""
    inside = ~breaks[buffer]
    edge = np.zeros(len(buffer) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(buffer), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(buffer), dtype=bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(buffer, starts, ends, np.searchsorted(starts, offsets))
