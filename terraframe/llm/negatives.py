"""Hard negatives of anchor vectors by Fagin's threshold algorithm.

Vectors become integers, ``floor(256 x)`` a component, and a score is an
integer inner product, so every order and every tie is exact. Candidates are
read in blocks. A block keeps one sorted list per dimension; an anchor walks
each list from the end that its own component favours (sorted access), scores
whatever rows come up for the first time as a whole (random access), and stops
as soon as the threshold, the best score that an unseen row can still have,
lies strictly below what each of its windows needs: the window's k-th score
once it has k rows, else its lower end. Rows that tie with the k-th score are
therefore always seen.

Two searches: first the best rows of an anchor's own label, then, for each of
these, the best rows of other labels inside its window of scores. Every task
searches all anchors of one chunk in its own candidates; the few rows that each
finds are merged by rank. Anchors are a stated query set: they are sent to the
tasks in chunks of ``CHUNK_BYTES``, one search after the other, each against all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraframe.llm.storage import stored

#: Bytes of a block of candidates, of a chunk of anchors (8 bytes a component).
BLOCK_BYTES, CHUNK_BYTES = 4 << 20, 16 << 20
#: Rows of a block at most, entries read of each list at once (doubled from step to step).
BLOCK_ROWS, STEP = 8192, 128


def integer_vectors(df: DataFrame, id: str, vector: str, label: Column, is_anchor: Column) -> DataFrame:
    """(``uid, id, label, anchor, v``) of the rows that take part, written: a label, a vector, only finite components."""
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = df.select(
        F.col(f"`{id}`").cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.transform(x, lambda c: F.floor(256 * c).cast("double")).alias("v"),
        finite.alias("finite"),
    )
    rows = rows.where("finite AND label IS NOT NULL").drop("finite")
    return stored(rows.withColumn("uid", F.monotonically_increasing_id()))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of lists; shorter ones end in zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), -1)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``a``: exact up to 2^63, beyond that rounded and clipped."""
    most = np.abs(x).max(initial=0.0) * np.abs(a).max(initial=0.0) * max(1, len(a))
    if most < 2.0**53:
        return (x @ a).astype(np.int64)
    if most < 2.0**63:
        return x.astype(np.int64) @ a.astype(np.int64)
    return np.clip(x @ a, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


class Block:
    """Candidates with one sorted list a dimension."""

    def __init__(self, uid: np.ndarray, id: np.ndarray, none: np.ndarray, label: np.ndarray, x: np.ndarray):
        self.uid, self.id, self.none, self.label, self.x = uid, id, none, label, x
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(x, self.order, axis=0)

    def part(self, rows: np.ndarray) -> Block:
        return Block(self.uid[rows], self.id[rows], self.none[rows], self.label[rows], self.x[rows])

    def search(self, anchor: np.ndarray, found: Callable, done: Callable) -> None:
        """``found(rows, scores)`` for rows in the order of sorted access, until ``done(threshold)``."""
        n, width = len(self.x), min(self.x.shape[1], len(anchor))
        a = anchor[:width]
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        if not n or not len(up) + len(down):
            found(np.arange(n), np.zeros(n, dtype=np.int64))
            return

        def threshold(rank: int) -> int:
            ends = np.zeros(width)
            ends[up], ends[down] = self.values[n - 1 - rank, up], self.values[rank, down]
            return int(products(ends[None, :], a)[0])

        if done(threshold(0)):
            return
        seen = np.zeros(n, dtype=bool)
        depth, step = 0, STEP
        while depth < n:
            upto = min(n, depth + step)
            met = np.zeros(n, dtype=bool)
            met[self.order[n - upto : n - depth, up].ravel()] = True
            met[self.order[depth:upto, down].ravel()] = True
            rows = np.flatnonzero(met & ~seen)
            seen |= met
            found(rows, products(self.x[rows, :width], a))
            if done(threshold(upto - 1)):
                return
            depth, step = upto, 2 * step


class Windows:
    """The best ``k`` rows in each of an anchor's ranges of scores (``low`` to ``high``, both included)."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.kept = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))  # score, id is null, id, uid
        self.needs = low.copy()

    def add(self, score: np.ndarray, none: np.ndarray, id: np.ndarray, uid: np.ndarray) -> None:
        good = (score >= self.needs.min()) & (score <= self.high.max())
        if not good.any():
            return
        new = (score[good], none[good], id[good], uid[good])
        s, none, id, uid = (np.concatenate(x) for x in zip(self.kept, new, strict=True))
        at = np.lexsort((id, none, -s))
        s = s[at]
        keep = np.zeros(len(s), dtype=bool)
        for w, (low, high) in enumerate(zip(self.low.tolist(), self.high.tolist(), strict=True)):
            first = np.searchsorted(-s, -high, side="left")
            last = np.searchsorted(-s, -low, side="right")
            if last - first >= self.k:
                last = first + self.k
                self.needs[w] = s[last - 1]
            keep[first:last] = True
        at = at[keep]
        self.kept = (s[keep], none[at], id[at], uid[at])

    def done(self, threshold: int) -> bool:
        return threshold < self.needs.min()


#: Ends of a window that takes all scores.
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held: list[pa.RecordBatch] = []

    def block() -> Block:
        t = pa.Table.from_batches(held)
        id = t.column("id")
        return Block(
            t.column("uid").to_numpy(),
            id.fill_null(0).to_numpy(),
            id.is_null().to_numpy().astype(np.int64),
            t.column("label").to_numpy(),
            matrix(t.column("v")),
        )

    rows = size = 0
    for b in batches:
        first = 0
        while first < b.num_rows:
            part = b.slice(first, BLOCK_ROWS - rows)
            part = part.slice(0, max(1, int(part.num_rows * min(1.0, (BLOCK_BYTES - size) / max(1, part.column("v").nbytes)))))
            held.append(part)
            first, rows, size = first + part.num_rows, rows + part.num_rows, size + part.column("v").nbytes
            if rows >= BLOCK_ROWS or size >= 0.9 * BLOCK_BYTES:
                yield block()
                held.clear()
                rows = size = 0
    if rows:
        yield block()


_FOUND = "anchor long, low long, high long, score long, id long, uid long"


def _search(rows: DataFrame, anchors: pa.Table, same: bool, k: int) -> DataFrame:
    """What each task finds for ``anchors`` (``uid, label, v, high``) among its own ``rows``: at most ``k`` rows a window."""
    a = rows.sparkSession.sparkContext.broadcast(
        (
            anchors.column("uid").to_numpy(),
            anchors.column("label").to_numpy(),
            matrix(anchors.column("v")),
            anchors.column("high").to_pylist(),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, label, v, tops = a.value
        windows = []
        for high in tops:
            h = np.array(high, dtype=np.int64)
            low = np.full(len(h), _LEAST) if same else np.array([-(-80 * x // 100) for x in high], dtype=np.int64)
            windows.append(Windows(low[low <= h], h[low <= h], k))
        for block in _read(batches):
            own = {}
            if same:
                wanted = np.intersect1d(label, block.label)
                own = {x: block.part(np.flatnonzero(block.label == x)) for x in wanted.tolist()}
            for i, w in enumerate(windows):
                one = own.get(int(label[i])) if same else block
                if one is None or not len(w.low):
                    continue

                def found(at, score, one=one, w=w, i=i):
                    use = one.uid[at] != uid[i] if same else one.label[at] != label[i]
                    at, score = at[use], score[use]
                    w.add(score, one.none[at], one.id[at], one.uid[at])

                one.search(v[i], found, w.done)
        for first in range(0, len(windows), 1000):
            out = []
            for i, w in enumerate(windows[first : first + 1000], first):
                score, none, id, cand = w.kept
                for low, high in zip(w.low.tolist(), w.high.tolist(), strict=True):
                    at = np.flatnonzero((score >= low) & (score <= high))[:k]
                    out.extend((int(uid[i]), low, high, int(score[j]), None if none[j] else int(id[j]), int(cand[j])) for j in at)
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            names = ["anchor", "low", "high", "score", "id", "uid"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return rows.select("uid", "id", "label", "v").mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each window, with their ``rank``."""
    order = Window.partitionBy("anchor", "high").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _in_chunks(rows: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchors``: a written table; one search for each chunk of it."""
    size = anchors.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0
    chunks = -(-size // CHUNK_BYTES)
    chunk = F.pmod(F.xxhash64("uid"), F.lit(max(1, chunks)))
    found = [stored(_best(_search(rows, anchors.where(chunk == i).toArrow(), same, k), k)) for i in range(chunks)]
    empty = rows.sparkSession.createDataFrame([], _FOUND + ", rank int")
    return reduce(DataFrame.unionByName, found, empty)


def hard_negatives(df: DataFrame, id: str, vector: str, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 5) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among the rows of ``df``.

    label, is_anchor: columns over ``df``. An anchor's positives are the first
    ``positives`` other rows of its label; for each, the first ``negatives`` rows of
    other labels whose score is at least 0.8 times and at most the positive's.
    First means a higher score, then a smaller id; null ids come last. rank
    counts from 1. A positive without such rows gives no row.

    Rows without a label or vector, and vectors with a null, NaN or infinite
    component, take no part. A shorter vector counts as ending in zeros (an
    empty one scores 0). Components beyond 2^63 / 256 are clipped. Repeated
    rows are rows of their own: anchors, positives and negatives, each time.
    """
    rows = integer_vectors(df, id, vector, label, is_anchor)
    anchors = rows.where("anchor")
    # as many tasks as there are cores, or more once a task would hold more than a block
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    rows = stored(rows.drop("anchor").repartition(parts))
    near = _in_chunks(rows, anchors.select("uid", "label", "v", F.array(F.lit(_MOST)).alias("high")), True, positives)
    near = near.select("anchor", F.col("score").alias("high"), F.col("id").alias("positive_id"))
    tops = near.groupBy(F.col("anchor").alias("uid")).agg(F.array_sort(F.collect_set("high")).alias("high"))  # at most ``positives``
    wanted = stored(anchors.join(tops, "uid").select("uid", "label", "v", "high"))
    far = _in_chunks(rows, wanted, False, negatives).select("anchor", "high", "rank", "score", F.col("id").alias("negative_id"))
    pairs = near.join(far, ["anchor", "high"])
    named = pairs.join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))
