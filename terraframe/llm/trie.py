"""Prefix trie of conversations, its subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is named by hashes of the
sequence (running sums of hashes of turn and place, 128 bits) and placed by
its smallest member and its depth: all nodes with the same smallest member are
one downward path, and a parent comes before its children in the order

    (hashes of the first and second turn, smallest member, depth),

which is almost the order of a walk through the trie.

* Shards are ranges of that order, so each is a piece of the trie whose nodes
  have parents in it or in earlier shards.
* Inside a shard, nodes are sorted by reverse level order (by Spark, which
  spills) and pass their totals to their parents forward in time, through a
  priority queue that spills sorted runs.
* What leaves a shard is added up by the parent it goes to: the *shard roots* of
  one parent are one entry. These form a small trie of their own, solved in the
  same way for each first turn; then every shard is swept once more with what it
  receives from others. The root of all needs no messages, its totals are plain sums.

A conversation, a first turn or a path may hold any share of all rows: places
and running sums are found in ranges of rows, with what earlier ranges hold of
the same conversation added on; nothing is grouped by conversation or parent
without a partial aggregate before it.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraframe.llm.storage import small, stored

#: Entries of a queue kept in memory; a sorted run of the file is read by so many at once.
QUEUE, RUN = 200_000, 1_000
#: Conversation ids written as one piece of text before hashing.
IDS = 5_000
#: A parent with more than this share of all nodes as children is joined by broadcast: fewer than 500 of them.
HOT_SHARE = 500

_SPACE = r"[\x20\x09-\x0D]+"


def turn_keys(turns: DataFrame, conv: str, role: str, text: str, *others: str) -> DataFrame:
    """``conv, t1, t2, words`` and ``others``: a turn by hashes of role and text (null: empty), with its number of words."""
    r, t = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    words = F.size(F.filter(F.split(t, _SPACE, -1), lambda w: w != "")).cast("long")
    keys = [F.xxhash64(F.lit(i), r, t).alias(f"t{i}") for i in (1, 2)]
    rest = [F.col(f"`{c}`") for c in others]
    return turns.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), *rest, *keys, words.alias("words"))


def _spans(parts: DataFrame, *sums: Column) -> DataFrame:
    """For conversations in several ranges: what earlier ranges hold (``before_...``) and whether more follow. Two rows a range at most."""
    names = [f"s{i}" for i in range(len(sums))]
    by = parts.groupBy("conv", "part").agg(F.count("*").alias("n"), *[s.alias(n) for s, n in zip(sums, names, strict=True)])
    order = Window.partitionBy("conv").orderBy("part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns(
        {f"before_{n}": F.sum(n).over(earlier) for n in ["n", *names[:4]]}
        | {f"of_{n}": F.max(n).over(Window.partitionBy("conv")) for n in names[4:]}
        | {"more": F.lead("part").over(order).isNotNull()}
    )
    return small(stored(by.where("more OR before_n IS NOT NULL").drop("n", *names)))


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` (with ``conv``), written, with ``pos`` (from 1) and ``last`` in the ``order`` of its conversation; ``part`` names a range."""
    parts = stored(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part", "conv")
    parts_seen = _spans(parts)
    found = parts.withColumns({"pos": F.row_number().over(here.orderBy(*order)).cast("long"), "n": F.count("*").over(here)})
    found = found.join(parts_seen, ["part", "conv"], "left")
    last = (F.col("pos") == F.col("n")) & ~F.coalesce("more", F.lit(False))
    found = found.withColumn("last", last).withColumn("pos", F.col("pos") + F.coalesce("before_n", F.lit(0)))
    return stored(found.drop("n", "before_n", "more"))


def _prefixes(rows: DataFrame) -> DataFrame:
    """``conv, pos, last, words``, the node (``a, b``), its parent (``pa, pb``) and the node's place ``k``."""
    one, two = F.xxhash64("t1", "t2", "pos"), F.xxhash64(F.lit(7), "t2", "t1", "pos")
    lanes = [one.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(one, 32), two.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(two, 32)]
    rows = rows.withColumns({f"l{i}": x for i, x in enumerate(lanes)})
    turn = [F.max(F.when(F.col("pos") == p, F.xxhash64("t1", "t2").bitwiseAND(0x3FFFFFFF) + 1)) for p in (1, 2)]
    carried = _spans(rows, *[F.sum(f"l{i}") for i in range(4)], *turn)
    here = Window.partitionBy("part", "conv")
    running = here.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"u{i}": F.sum(f"l{i}").over(running) for i in range(4)} | {f"h{p}": t.over(here) for p, t in enumerate(turn)})
    rows = rows.join(carried, ["part", "conv"], "left")
    sums = [F.col(f"u{i}") + F.coalesce(f"before_s{i}", F.lit(0)) for i in range(4)]
    rows = rows.withColumns({f"u{i}": s for i, s in enumerate(sums)} | {f"h{p}": F.coalesce(f"of_s{4 + p}", f"h{p}") for p in (0, 1)})

    def name(sums: list[Column], pos: Column) -> tuple[Column, Column]:
        a, b = F.xxhash64(*sums, pos), F.xxhash64(F.lit(3), *sums[::-1], pos)
        return F.when(pos > 0, a).otherwise(0), F.when(pos > 0, b).otherwise(0)

    own = name([F.col(f"u{i}") for i in range(4)], F.col("pos"))
    up = name([F.col(f"u{i}") - F.col(f"l{i}") for i in range(4)], F.col("pos") - 1)
    k = F.shiftleft("h0", 32) + F.when(F.col("pos") > 1, F.col("h1")).otherwise(0)
    return rows.select("conv", "pos", "last", "words", *[c.alias(n) for c, n in zip((*own, *up, k), ("a", "b", "pa", "pb", "k"), strict=True)])


def _nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node, written: ``a, b, c`` (smallest member), ``d, n_convs, words, k, n_children``, its parent's ``pa, pb, pc, pk``."""
    same = [F.min(x).alias(y) for x, y in (("pos", "d"), ("words", "words"), ("pa", "pa"), ("pb", "pb"), ("k", "k"))]
    nodes = prefixes.groupBy("a", "b").agg(F.min("conv").alias("c"), F.count("*").alias("n_convs"), *same)
    zero = [F.lit(0).cast("long").alias(n) for n in ("d", "words", "pa", "pb", "k")]
    root = convs.agg(F.min("conv").alias("c"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "c", "n_convs", *zero)
    nodes = nodes.unionByName(root)
    count = nodes.where("d > 0").groupBy("pa", "pb").agg(F.count("*").alias("n_children")).toDF("a", "b", "n_children")
    nodes = stored(nodes.join(count, ["a", "b"], "left").fillna(0, ["n_children"]))
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("c").alias("pc"), "n_children")
    hot = parents.where(F.col("n_children") > nodes.count() / HOT_SHARE).drop("n_children")  # fewer than HOT_SHARE
    below, on = nodes.where("d > 0"), ["pa", "pb"]
    joined = below.join(F.broadcast(hot), on).unionByName(below.join(F.broadcast(hot), on, "left_anti").join(parents.drop("n_children"), on))
    joined = joined.unionByName(nodes.where("d = 0").withColumn("pc", F.lit(None).cast("long")))
    head = F.shiftleft(F.shiftright("k", 32), 32)
    return joined.withColumn("pk", F.when(F.col("d") < 2, 0).when(F.col("d") == 2, head).otherwise(F.col("k")))


class SpillingQueue:
    """Totals on their way to nodes, smallest key first.

    Entries are tuples that begin with the node's key. Beyond ``limit`` entries
    a sorted run goes to an unnamed temporary file of the task, which vanishes with it.
    """

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.heads = limit, [], [], []

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        self.heap.sort()
        for first in range(0, len(self.heap), RUN):
            pickle.dump(self.heap[first : first + RUN], file)
        self.heap = []
        file.seek(0)
        self.runs.append(self._read(file))
        self._next(len(self.runs) - 1)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, run: int) -> None:
        entry = next(self.runs[run], None)
        if entry is not None:
            heapq.heappush(self.heads, (entry, run))

    def pop(self, key: tuple) -> tuple[int, int]:
        """Sums of the last two values of all entries for ``key``."""
        one = two = 0
        n = len(key)
        while self.heap and self.heap[0][:n] == key:
            *_, x, y = heapq.heappop(self.heap)
            one, two = one + x, two + y
        while self.heads and self.heads[0][0][:n] == key:
            (*_, x, y), run = heapq.heappop(self.heads)
            one, two = one + x, two + y
            self._next(run)
        return one, two


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(n).to_pylist() for n in names], strict=True)


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    held = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=names)

    for row in rows:
        held.append(row)
        if len(held) == 10_000:
            yield batch()
            held = []
    if held:
        yield batch()


_TREE = ["shard", "k", "c", "d", "pk", "pc", "leaves", "saved"]
_KEPT = ["a", "b", "n_convs", "n_children"]
_PORT = ["shard", "qshard", "qk", "qc", "qd", "leaves", "saved"]


def _longs(names: list[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def _sweep(tree: DataFrame, lows: list[tuple], ports: bool, limit: int) -> DataFrame:
    """One pass over each shard in reverse level order.

    tree: nodes, and rows without ``node`` that bring totals from other shards.
    ports: return what leaves the shards (``_PORT``), else all nodes with their totals.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, queue, low, out = None, None, None, {}

        def leave() -> Iterator[tuple]:
            for (k, c, d), (x, y) in out.items():
                yield current, bisect_right(lows, (k, c, d)) - 1, k, c, d, x, y
            out.clear()

        for shard, k, c, d, pk, pc, leaves, saved, node, *kept in _rows(batches, *_TREE, "node", *_KEPT):
            if shard != current:
                yield from leave()
                current, queue, low = shard, SpillingQueue(limit), lows[shard]
            key = (-d, k, c)
            if not node:
                queue.push((*key, leaves, saved))
                continue
            x, y = queue.pop(key)
            leaves, saved = leaves + x, saved + y
            if not ports:
                yield c, d, pc, leaves, saved, *kept
            if d > 1:  # the root is not sent anything
                up = (pk, pc, d - 1)
                if up >= low:
                    queue.push((1 - d, pk, pc, leaves, saved))
                elif ports:
                    x, y = out.get(up, (0, 0))
                    out[up] = (x + leaves, y + saved)
                    if len(out) > limit:
                        yield from leave()
        yield from leave()

    names = _PORT if ports else ["c", "d", "pc", "leaves", "saved", *_KEPT]
    dealt = tree.repartition("shard").sortWithinPartitions("shard", F.desc("d"), "k", "c", "node")
    return dealt.mapInArrow(lambda batches: _batches(own(batches), names), _longs(names))


def _exits(tree: DataFrame, lows: list[tuple]) -> DataFrame:
    """For each path of each shard (``shard, k, c``): the node of an earlier shard (``uk, uc, ud``) that its nodes come under; null: only the root."""
    pieces = tree.groupBy("shard", "k", "c").agg(F.min(F.struct("d", "pk", "pc")).alias("top"))
    pieces = pieces.select("shard", "k", "c", "top.d", "top.pk", "top.pc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, known = None, {}
        for shard, k, c, d, pk, pc in _rows(batches, "shard", "k", "c", "d", "pk", "pc"):
            if shard != current:
                current, known = shard, {}
            if d < 2:
                known[k, c] = (None, None, None)
            elif (pk, pc, d - 1) >= lows[shard]:
                known[k, c] = known[pk, pc]
            else:
                known[k, c] = (pk, pc, d - 1)
            yield shard, k, c, *known[k, c]

    names = ["shard", "k", "c", "uk", "uc", "ud"]
    dealt = pieces.repartition("shard").sortWithinPartitions("shard", "k", "c")
    return dealt.mapInArrow(lambda batches: _batches(run(batches), names), _longs(names))


def _between(ports: DataFrame, exits: DataFrame, limit: int) -> DataFrame:
    """What each node receives from later shards (``shard, k, c, d, leaves, saved``): time-forward over the shard roots of each first turn."""
    named = exits.select(F.col("shard").alias("qshard"), F.col("k").alias("qk"), F.col("c").alias("qc"), "uk", "uc", "ud")
    tied = named.join(ports, ["qshard", "qk", "qc"]).withColumn("turn", F.shiftright("qk", 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, queue = None, None
        columns = ("turn", "shard", "qk", "qc", "qd", "qshard", "uk", "uc", "ud", "leaves", "saved")
        for turn, shard, k, c, d, to, uk, uc, ud, leaves, saved in _rows(batches, *columns):
            if turn != current:
                current, queue = turn, SpillingQueue(limit)
            x, y = queue.pop((-shard, k, c, d))
            leaves, saved = leaves + x, saved + y
            yield to, k, c, d, leaves, saved
            if uk is not None:
                queue.push((-to, uk, uc, ud, leaves, saved))

    names = ["shard", "k", "c", "d", "leaves", "saved"]
    dealt = tied.repartition("turn").sortWithinPartitions("turn", F.desc("shard"), "qk", "qc", "qd")
    found = dealt.mapInArrow(lambda batches: _batches(run(batches), names), _longs(names))
    return found.groupBy("shard", "k", "c", "d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _totals(nodes: DataFrame, limit: int) -> DataFrame:
    """``nodes`` by ``c, d, pc, leaves, saved`` and ``_KEPT``: the sums over each subtree."""
    own = nodes.withColumns(
        {"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words"), "node": F.lit(True)}
    )
    own = own.select(*_TREE[1:], "node", *_KEPT).repartitionByRange("k", "c", "d")
    tree = stored(own.withColumn("range", F.spark_partition_id()))
    firsts = tree.groupBy("range").agg(F.min(F.struct("k", "c", "d")).alias("low")).orderBy("range").collect()  # one a range
    lows = [tuple(r["low"]) for r in firsts]
    if not lows:
        return tree.select("c", "d", "pc", "leaves", "saved", *_KEPT)
    numbers = F.create_map(*[F.lit(x) for i, r in enumerate(firsts) for x in (r["range"], i)])
    tree = tree.withColumn("shard", numbers[F.col("range")].cast("long")).drop("range")
    below = tree.where("d > 0")
    if len(lows) > 1:
        ports = _sweep(below, lows, True, limit).groupBy(*_PORT[:5]).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        ports = stored(ports)
        received = _between(small(ports), _exits(below, lows), limit)
        none = {n: F.lit(None).cast("long") for n in ("pk", "pc", *_KEPT)}
        below = below.unionByName(stored(received).withColumns(none | {"node": F.lit(False)}))
    done = stored(_sweep(below, lows, False, limit))
    sums = tree.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = tree.where("d = 0").drop("leaves", "saved").crossJoin(F.broadcast(sums))  # one row each
    return done.unionByName(root.select(*done.columns))


def ids_digest(ends: DataFrame) -> DataFrame:
    """(``a, b, ends_sha256``): the SHA-256 of the decimal ``conv`` of each node's rows, ascending, joined by commas.

    Ids become pieces of text in ranges of rows; a node's pieces, far fewer than its ids, then stream through one hash.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def flush() -> None:
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            types = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["a", "b", "first", "text"])

        for a, b, conv in _rows(batches, "a", "b", "conv"):
            if node != (a, b) or len(ids) == IDS:
                flush()
                node = (a, b)
                if len(out) == 2_000:
                    yield batch()
                    out.clear()
            ids.append(conv)
        flush()
        yield batch()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            types = [pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["a", "b", "ends_sha256"])

        for a, b, text in _rows(batches, "a", "b", "text"):
            if node != (a, b):
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256()
                if len(out) == 10_000:
                    yield batch()
                    out.clear()
            else:
                state.update(b",")
            state.update(text.encode())
        if node:
            out.append((*node, state.hexdigest()))
        yield batch()

    ranged = ends.select("a", "b", "conv").repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    texts = ranged.mapInArrow(pieces, "a long, b long, first long, text string")
    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, *order: str, limit: int = QUEUE) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    turns: ``conv, t1, t2, words`` as ``turn_keys`` makes them and the columns
    of ``order``; equal places are told apart by the hashes of the turns.
    convs: the distinct ``conv`` of all conversations, those without turns as
    well; they end at the root. A node's turn is turn number ``depth`` of
    conversation ``conv_id``, its smallest member. Repeated rows are turns of
    their own. Without conversations there is no node, not even a root.
    """
    placed = numbered(turns, *order, "t1", "t2")
    prefixes = stored(_prefixes(placed))
    ends = prefixes.where("last").select("conv", "a", "b")
    silent = convs.join(ends.select("conv"), "conv", "left_anti")
    ends = ends.unionByName(silent.withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")}))
    totals = _totals(_nodes(prefixes, convs), limit)
    out = totals.join(ids_digest(ends), ["a", "b"], "left")
    return out.select(
        F.col("c").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("pc").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
