"""Near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles, sketched by ``BINS`` minwise
tokens. Independent trees branch the documents: at each level a document goes
to the child named by one of its tokens, another one for each tree and level,
so two sets of similarity s stay together for k levels with probability s to
the power of k. Nodes of at most ``NODE`` different sets are compared
exhaustively, larger ones branch on.

* ``TREES`` trees take all documents to level ``LEVELS``. Documents that share
  no more than a passage have parted by then, so nearly all nodes are small, and
  sixteen trees miss a pair of similarity 0.8 with a probability of 1e-5.
* Members of nodes that are still large are many and alike. They alone go
  through ``DENSE_TREES`` more trees, deeper ones with twice as large nodes. A pair
  of similarity 0.8 shares no node of level 6 with a probability of 2e-4.
* Nodes that are large at level 6 branch on to level 12, which connects most of
  their members cheaply but would miss 13 % of such pairs. So members outside
  a node's largest component are then compared with all members of the node,
  in blocks: no pair of a node of level 6 is left out but those that are
  connected already, at a cost of the node times those that are still apart.

Equal sets are one class from the start. A small node first gives a spanning
forest of its plausible pairs, judged by the sketches; only members that are
then still in different components are compared with each other, now by the
``FINE`` smallest shingles of each (the whole set, if it has no more). Every
link is confirmed on the full sets, from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraframe.llm.components import components
from terraframe.llm.storage import parts_of, small, stored
from terraframe.llm.words import mixed, rolling, slices, words

BINS = 256
TREES, LEVELS = 16, 3
DENSE_TREES, DENSE_LEVELS = 28, 12
#: Different sets in a node that are compared exhaustively.
NODE = 64
#: Shingles of a set that the second comparison looks at.
FINE = 256
#: A pair is plausible if its sketches agree within so many standard deviations of the wanted similarity.
SLACK = 3.0

_DRAW = np.random.default_rng(11)
#: Tokens that name the children: (tree, level); no token twice in a tree.
_STEPS = [_DRAW.permutation(BINS)[:DENSE_LEVELS].tolist() for _ in range(TREES + DENSE_TREES)]
#: Where an empty bin looks for a token, attempt by attempt.
_PROBES = _DRAW.integers(0, BINS, (64, BINS))


def shingle_rows(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of documents: the first one's number, and the sorted set of shingle hashes of each."""
    for first, _, buffer, offsets in slices(column):
        w = words(buffer, offsets)
        hashes = w.hashes()
        runs = rolling(hashes, width)
        out = []
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(runs[a : b - width + 1]))
            else:  # a text of fewer words is one shingle
                out.append(rolling(hashes[a:b], b - a) if b > a else hashes[:0])
        yield first, out


def sketches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(documents, 2.5 ``BINS``) bytes of the 16-bit minwise tokens of sorted sets; all 0 for an empty set.

    First all low bytes, then all high bytes, then the lowest four bits of
    each two tokens in one byte: enough to estimate a similarity.

    One permutation: a shingle's first byte is its bin, the smallest of a bin
    its token. An empty bin copies the token of the first full bin that its
    fixed list of probes meets (then the next full bin), which agrees for two
    sets as often as their similarity says.
    """
    out = np.zeros((len(sizes), BINS), dtype=np.uint16)
    cell = np.repeat(np.arange(len(sizes)), sizes) * BINS + (flat >> np.uint64(56)).astype(np.int64)
    lead = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, dtype=bool)
    full = np.zeros(out.size, dtype=bool)
    full[cell[lead]] = True
    out.ravel()[cell[lead]] = (mixed(flat[lead]) >> np.uint64(48)).astype(np.uint16)
    full = full.reshape(out.shape)
    tokens, had = out.copy(), full.copy()
    rows = np.flatnonzero((sizes > 0) & ~full.all(axis=1))
    for probe in _PROBES:
        if not len(rows):
            break
        fill = ~had[rows] & full[rows][:, probe]
        part = tokens[rows]
        part[fill] = out[rows][:, probe][fill]
        tokens[rows] = part
        had[rows] |= fill
        rows = rows[~had[rows].all(axis=1)]
    for r in rows.tolist():
        at = np.flatnonzero(full[r])
        rest = np.flatnonzero(~had[r])
        tokens[r, rest] = out[r, at[np.searchsorted(at, rest) % len(at)]]
    low, bits = tokens.astype(np.uint8), tokens.astype(np.uint8) & 15
    return np.hstack([low, (tokens >> np.uint16(8)).astype(np.uint8), bits[:, ::2] << 4 | bits[:, 1::2]])


def signatures(docs: DataFrame, text: str, width: int) -> DataFrame:
    """Columns of ``docs`` but ``text``, with ``n_shingles``, ``sig`` (128 bits of the set) and ``sketch``."""
    kept = [c for c in docs.columns if c != text]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))
    schema = T.StructType([source.schema[c] for c in kept])
    schema = schema.add("n_shingles", "long").add("sig", T.BinaryType()).add("sketch", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, sets in shingle_rows(b.column(len(kept)), width):
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate(sets)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                key = np.zeros((len(sets), 2), dtype=np.uint64)
                if len(full):
                    key[full, 0] = np.add.reduceat(flat, starts)
                    key[full, 1] = np.add.reduceat(mixed(flat), starts)
                rest = b.slice(first, len(sets)).columns[: len(kept)]
                new = [pa.array(sizes), _fixed(key), _fixed(sketches(flat, sizes))]
                yield pa.RecordBatch.from_arrays([*rest, *new], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def _paths(rows: DataFrame, trees: range, levels: int) -> DataFrame:
    """(``tree``, ``sig``, ``path``): the tokens that name the children of a set in each tree, two bytes a level."""
    steps = np.array([_STEPS[t][:levels] for t in trees])
    places = np.stack([steps, steps + BINS], axis=2).reshape(len(trees), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                path = raw[:, places].reshape(-1, 2 * levels)
                names = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(trees))))
                number = pa.array(np.tile(np.array(trees, dtype=np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([number, names, _fixed(path)], names=["tree", "sig", "path"])

    return rows.select("sig", "sketch").mapInArrow(run, "tree int, sig binary, path binary")


def _fixed(values: np.ndarray) -> pa.Array:
    """One binary for each row of bytes."""
    values = np.ascontiguousarray(values)
    width = values.shape[1] * values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _branch(rows: DataFrame, trees: range, levels: int, stride: int, node_size: int, parts: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nodes (``tree, node, sig``) of two to ``node_size`` sets, and the larger ones of each level that was looked at.

    rows: ``sig`` and ``sketch``. ``stride`` tokens are taken before sizes are looked at.
    """
    rows = _paths(rows, trees, levels).withColumn("node", F.lit(0).cast("long"))
    fit, large = [], []
    for level in range(0, levels, stride):
        rows = rows.withColumn("node", F.xxhash64("node", "tree", F.substring("path", 2 * level + 1, 2 * stride)))
        counts = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        rows = stored(rows.join(small(stored(counts, parts)), "node"), parts)
        fit.append(rows.where(F.col("n") <= node_size).select("tree", "node", "sig"))
        rows = rows.where(F.col("n") > node_size).drop("n")
        large.append(rows.select("tree", "node", "sig"))
        if rows.isEmpty():
            break
    return fit, large


def _merged(fit: list[DataFrame], roots: DataFrame | None) -> DataFrame:
    """(``node``, ``sig``, ``root``) of the small nodes, those with the same members once.

    With ``roots``, only nodes with members of more than one component.
    """
    rows = fit[0]
    for other in fit[1:]:
        rows = rows.unionByName(other)
    rows = _rooted(rows, roots)
    nodes = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sig", "root"))).alias("m"))  # at most NODE
    nodes = nodes.where(F.size(F.array_distinct("m.root")) > 1)
    once = nodes.groupBy(F.xxhash64("m.sig").alias("node")).agg(F.first("m").alias("m"))
    return once.select("node", F.explode("m").alias("m")).select("node", "m.sig", "m.root")


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("sig"))
    found = roots.select(F.col("node").alias("sig"), "root")
    return rows.join(small(found), "sig", "left").withColumn("root", F.coalesce("root", "sig"))


def _gathered(few: DataFrame, sketches: DataFrame) -> DataFrame:
    """One row for each small node: its members with size ``n``, component and ``sketch``."""
    rows = few.join(sketches, "sig")
    return rows.groupBy("node").agg(F.collect_list(F.struct("sig", "n", "sketch", "root")).alias("m"))  # at most NODE


def _coarse(sketches: list[bytes], sizes: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of members and the share of tokens they agree in, where that leaves room for the wanted similarity."""
    i, j = np.triu_indices(len(sizes), 1)
    tokens = np.array([np.frombuffer(s, dtype=np.uint8) for s in sketches])
    bits = np.stack([tokens >> 4, tokens & 15], axis=2).reshape(len(tokens), -1)
    agree = ((bits[i] == bits[j]).mean(axis=1) - 1 / 16) / (1 - 1 / 16)  # one token in 16 agrees by chance
    seen = np.minimum(BINS, np.maximum(1, np.maximum(sizes[i], sizes[j])))
    good = (agree >= wanted - SLACK * np.sqrt(wanted * (1 - wanted) / seen)) & (
        np.minimum(sizes[i], sizes[j]) >= wanted * np.maximum(sizes[i], sizes[j])
    )
    return i[good], j[good], agree[good]


def _close(sketches: list[bytes], sizes: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_coarse``, by the smallest shingles: exact (but for equal 32-bit hashes) where they are the whole sets."""
    sets = [np.frombuffer(s, dtype=np.uint32) for s in sketches]
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(sets), len(values)), dtype=np.float32)
    has[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place] = 1
    common = has @ has.T
    length = np.array([len(s) for s in sets])
    top = np.array([s[-1] if n > len(s) else np.iinfo(np.uint32).max for s, n in zip(sets, sizes, strict=True)])
    out = []
    for i, j in np.argwhere(np.triu(common, 1) >= 0.5 * wanted * np.minimum(length[:, None], length)).tolist():
        if min(sizes[i], sizes[j]) < wanted * max(sizes[i], sizes[j]):
            continue
        upto = min(top[i], top[j])  # up to here both are complete
        a, b = sets[i][sets[i] <= upto], sets[j][sets[j] <= upto]
        both = len(np.intersect1d(a, b, assume_unique=True))
        whole = len(a) + len(b) - both
        error = 0.01 if upto == np.iinfo(np.uint32).max else SLACK * (wanted * (1 - wanted) / whole) ** 0.5
        if both >= (wanted - error) * whole:
            out.append((i, j, both / whole))
    i, j, alike = zip(*out, strict=True) if out else ((), (), ())
    return np.array(i, dtype=int), np.array(j, dtype=int), np.array(alike)


def _pairs(nodes: DataFrame, percent: int, judge, forest: bool) -> DataFrame:
    """Distinct pairs (``a`` < ``b``) that ``judge`` finds plausible among the members of each small node, of different components.

    forest: only as many as connect what is plausible, most alike first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for row in batch.column(0):
                members = row.as_py()
                i, j, alike = judge([m["sketch"] for m in members], np.array([m["n"] for m in members]), percent / 100)
                names = {m["root"]: m["root"] for m in members}

                def top(x, names=names):
                    while names[x] != x:
                        x = names[x]
                    return x

                for k in np.argsort(-alike, kind="stable").tolist():
                    x, y = members[i[k]], members[j[k]]
                    p, q = top(x["root"]), top(y["root"])
                    if p != q:
                        pairs.add((min(x["sig"], y["sig"]), max(x["sig"], y["sig"])))
                        if forest:
                            names[p] = q
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return nodes.select("m").mapInArrow(run, "a binary, b binary").distinct()


def _stars(nodes: DataFrame, parts: int) -> DataFrame:
    """Distinct pairs of a member and the node's pivot, for nodes that stayed large; the pivot differs from tree to tree."""
    order = F.xxhash64("tree", "sig")
    pivots = nodes.groupBy("node").agg(F.min(F.struct(order.alias("o"), "sig")).alias("p"))
    pivots = stored(pivots.select("node", F.col("p.sig").alias("pivot")), parts)
    met = nodes.join(small(pivots), "node").where("sig != pivot")
    return met.select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b")).distinct()


def _blocks(large: DataFrame, roots: DataFrame, node_size: int, parts: int) -> DataFrame:
    """Nodes (``tree, node, sig``) of about ``node_size`` members that hold all pairs still to be compared in nodes that stayed large.

    Members outside the node's largest component are the *rest*. All members
    are dealt into blocks, the rest also into lots, both of half that size,
    and each block meets each lot: a member is in as many of these as there
    are lots, one of the rest also in as many as there are blocks. Nodes of one component are left out.
    """
    half = node_size // 2
    rows = stored(_rooted(large, roots), parts)
    joined = rows.groupBy("node", "root").agg(F.count("*").alias("m"))
    sizes = joined.groupBy("node").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("most"), F.count("*").alias("k")).where("k > 1")
    blocks, lots = F.ceil(F.col("n") / half).cast("int"), F.ceil((F.col("n") - F.col("most.m")) / half).cast("int")
    sizes = stored(sizes.select("node", F.col("most.root").alias("most"), blocks.alias("blocks"), lots.alias("lots")), parts)
    rows = rows.join(small(sizes), "node")
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "sig"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    member = rows.select("tree", "node", "sig", deal(7, "blocks").alias("block"), every("lots").alias("lot"))
    rest = rows.where("root != most").select("tree", "node", "sig", every("blocks").alias("block"), deal(8, "lots").alias("lot"))
    met = member.unionByName(rest).distinct()
    return met.select("tree", F.xxhash64("node", "block", "lot").alias("node"), "sig")


def _texts(sigs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(``sig``, ``text``) of one document of each class in ``sigs``.

    The only step that moves texts of documents that may have no partner.
    """
    where = classes.select("sig", F.col("first.__doc").alias("__doc"), F.col("first.__tag").alias("__tag"))
    wanted = stored(where.join(sigs, "sig")).hint("merge")  # the same join at every size
    held = docs.withColumn("__tag", F.xxhash64("__text"))
    same = held["__doc"].eqNullSafe(wanted["__doc"]) & (held["__tag"] == wanted["__tag"])
    found = stored(held.join(wanted, same).select("sig", F.col("__text").alias("text")))
    if found.count() > wanted.count():  # rows repeated with id and text
        found = stored(found.groupBy("sig").agg(F.first("text").alias("text")))
    return found


def _fine(sigs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(``sig``, ``n``, ``sketch``): the size of the set and its ``FINE`` smallest shingles, 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, sets in shingle_rows(b.column(1), width):
                sketch = pa.array([np.unique((s >> np.uint64(32)).astype(np.uint32))[:FINE].tobytes() for s in sets], pa.binary())
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), sizes, sketch], names=["sig", "n", "sketch"])

    wanted = texts.join(sigs, "sig").select("sig", "text")
    found = wanted.mapInArrow(run, "sig binary, n long, sketch binary")
    return found.groupBy("sig").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets have ``100 * intersection >= percent * union``."""
    both = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                [s for _, sets in shingle_rows(batch.column(c), width) for s in sets] for c in ("ta", "tb")
            )
            good = []
            for x, y in zip(left, right, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, pairs.select("a", "b").schema).distinct()


def near_duplicates(
    docs: DataFrame, doc: str, text: str, width: int = 5, percent: int = 80, node_size: int = NODE
) -> DataFrame:
    """One row for each row of ``docs``: ``doc``, ``n_shingles``, ``n_links``, ``component_id``, ``kept``, ``stays`` and ``tag`` (xxhash64 of the text).

    Words are runs outside ASCII white space, A-Z lower-cased; a shingle is
    ``width`` words, a shorter text is one shingle. Texts are linked if 100
    times the intersection of their sets is at least ``percent`` times the
    union. component_id: the smallest id reachable over links, kept: it is
    the row's own. n_links: confirmed comparisons of the row's set with
    different sets. Texts without words (or null) are linked with nothing and
    stand for themselves; equal sets are linked; a null id is larger than all
    others. Repeated rows give repeated rows. stays: of each component, the
    rows of one id and text only, also where ids are null or repeated (then
    the text with the smallest hash); of a text without words, always.
    """
    rows = docs.select(F.col(f"`{doc}`").alias("__doc"), F.col(f"`{text}`").alias("__text"))
    signed = stored(signatures(rows.withColumn("__tag", F.xxhash64("__text")), "__text", width))
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("sig").agg(
        F.min(F.struct(F.col("__doc").isNull().alias("none"), "__doc", "__tag")).alias("first"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = stored(classes)
    parts = parts_of(classes)  # of all that follows
    fit, (large,) = _branch(classes, range(TREES), LEVELS, LEVELS, node_size, parts)
    coarse = classes.select("sig", "n", F.substring("sketch", 2 * BINS + 1, BINS // 2).alias("sketch"))
    together = stored(_merged(fit, None), parts)
    texts = _texts(together.select("sig").union(large.select("sig")).distinct(), classes, rows)
    forest = _pairs(_gathered(together, coarse), percent, _coarse, forest=True)
    tried = stored(forest.union(_stars(large, parts)).distinct(), parts)
    links = stored(_confirm(tried, texts, width, percent), parts)
    roots = stored(components(links, parts), parts)
    # members of large nodes go on, each in its own trees; what is linked by now is not looked at again
    dense = stored(classes.select("sig", "sketch").join(small(stored(large.select("sig").distinct(), parts)), "sig"), parts)
    more, larger = _branch(dense, range(TREES, TREES + DENSE_TREES), DENSE_LEVELS, DENSE_LEVELS // 2, 2 * node_size, parts)
    for forest in (True, False):  # what connects them first, then whatever is still apart
        rest = fit + more if forest else [*fit, *more, _blocks(larger[0], roots, 2 * node_size, parts)]
        open_nodes = stored(_merged(rest, roots), parts)
        fine = _fine(open_nodes.select("sig").distinct(), texts, width)
        pairs = _pairs(_gathered(open_nodes, fine), percent, _close, forest)
        pairs = pairs.union(_stars(larger[-1], parts)).distinct() if forest else pairs
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), parts)
        tried = tried.unionByName(pairs)
        links = stored(links.unionByName(_confirm(pairs, texts, width, percent)), parts)
        roots = stored(components(links, parts), parts)
    degree = links.select(F.col("a").alias("sig")).union(links.select("b")).groupBy("sig").agg(F.count("*").alias("n_links"))
    named = classes.select("sig", "first").join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left")
    named = named.withColumn("root", F.coalesce("root", "sig"))
    least = named.groupBy("root").agg(F.min("first").alias("lead"))
    lead = [F.col("lead.__doc").alias("component_id"), F.col("lead.__tag").alias("lead_tag")]
    labels = stored(named.join(least, "root").join(degree, "sig", "left").select("sig", *lead, "n_links"), parts)
    out = signed.select("__doc", "__tag", "n_shingles", "sig").join(small(labels), "sig", "left")
    return out.select(
        F.col("__doc").alias(doc),
        "n_shingles",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("__doc")).alias("component_id"),
        F.col("__tag").alias("tag"),
        ((F.col("n_shingles") == 0) | (F.col("__doc").eqNullSafe(F.col("component_id")) & (F.col("__tag") == F.col("lead_tag")))).alias("stays"),
    ).withColumn("kept", F.col(f"`{doc}`").eqNullSafe(F.col("component_id")))
