"""Token counts of whole texts with a ``tokenizers`` vocabulary file; only lengths come back.

Texts are cut at safe places: before white space that follows a visible
character. The byte-level pre-tokenizer starts a new piece exactly there, its
pattern never looks back, and special strings hold no white space, so the
counts of the parts add up to the count of the whole. (Texts with the control
characters 1C-1F, which are white space to one library and not to the other,
are left whole.) Equal parts are encoded once per task; the parts that are new
go to the library in batches of about ``BATCH_BYTES`` bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 256 << 10
#: Parts a task remembers; then it starts anew (a bound on memory, not on what is counted).
KNOWN_PARTS = 300_000

_PART = re.compile(r"\s*\S+|\s+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def parts(text: str) -> list[str]:
    """Pieces whose counts add up; joined they are the text."""
    return [text] if _ODD_SPACE.search(text) else _PART.findall(text)


def balanced(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of texts with about ``most`` bytes each; a longer text is a batch of its own."""
    batch, size = [], 0
    for t in texts:
        n = len(t.encode())
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += n
    if batch:
        yield batch


class Counter:
    """Counts of a vocabulary file, with the parts seen so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        split = [parts(t) for t in texts]
        if len(self.known) > KNOWN_PARTS:
            self.known.clear()
        new = sorted({p for s in split for p in s} - self.known.keys(), key=len)
        for batch in balanced(new):
            found = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
            self.known.update(zip(batch, map(len, found), strict=True))
        known = self.known.__getitem__
        return np.fromiter((sum(map(known, s)) for s in split), dtype=np.int64, count=len(texts))


def count_tokens(df: DataFrame, text: str, path: str, n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """All rows of ``df``, its columns but ``text``, and two longs: UTF-8 bytes and tokens of the whole text.

    A null text counts as empty (0 and 0). Columns of ``df`` called like the
    results are replaced. Rows keep their order and number; no shuffle.
    """
    kept = [c for c in df.columns if c not in (text, n_bytes, n_tokens)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    fields = [source.schema[c] for c in kept]
    schema = source.select(*[F.col(f"`{c}`") for c in kept]).schema.add(n_bytes, "long").add(n_tokens, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            texts = b.column(len(fields)).fill_null("")
            sizes, counts, first = [], [], 0
            lengths = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + 8 * BATCH_BYTES)))
                counts.append(counter.counts(texts.slice(first, last - first).to_pylist()))
                sizes.append(lengths[first:last])
                first = last
            new = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (sizes, counts)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(fields)], *new], names=[*kept, n_bytes, n_tokens])

    return source.mapInArrow(run, schema)
