"""Passages that repeat, exactly or nearly, in other documents or in the same one.

1. Seeds: runs of ``SEED`` words, thinned by winnowing (the smallest hash of
   every ``SPREAD`` neighbours), so any shared run of ``SEED + SPREAD - 1``
   words shares a seed.
2. Each seed that occurs twice is matched with its first occurrence only (the
   smallest document id, then position): a passage of m documents gives m - 1
   matches a seed and never all pairs.
3. Matches of a document with one other document are chained: collinear
   matches add up, gaps cost by their length, the best predecessor of a match
   is a prefix maximum in a Fenwick tree.
4. Chains are aligned word by word between their matches and extended at both
   ends over the words themselves; overlapping parts of a document are
   merged, and passages of ``min_words`` words or more are kept.
5. The first occurrences of a passage's seeds may lie in several unrelated
   documents, and then it has no chain. So runs of ``min_words`` words that
   no passage covers are compared as wholes with all earlier ones: each that
   occurs twice, word for word, is found whatever its seeds meet. Longer seeds,
   of which any such run has one, tell where to look.

Groups are at most a document long. Hot seeds are aggregated before they are
shuffled, and the join back to their occurrences can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.llm.storage import BROADCAST_BYTES, give_back, small, stored, stored_bytes
from terraframe.llm.words import mixed, rolling, slices, words
from terraframe.session import spread

SEED, SPREAD = 6, 16
#: A match is worth so much; a word of gap, on either side, costs so much.
GAIN, GAP = 6.0, 0.1
#: Matches a chain must have; 27 equal words always have two.
LEAST_SEEDS = 2
#: Requests for parts of one document that are answered together.
REQUESTS = 256
#: Bytes of parts of documents that are handed on together.
CUT_BYTES = 4 << 20
#: Words of context fetched around a chain; an unseeded margin is at most SEED + SPREAD - 1 words.
MARGIN = 40
#: Aligned words that a part of a passage must have, and the share of them that must be equal.
PART_WORDS, IDENTITY = 15, 0.8
#: Words between two parts of one passage, at most.
BRIDGE = 12
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Factor of neighbouring words in long runs (odd), and its inverse modulo 2^64.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def winnow(values: np.ndarray, bounds: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """Positions of the smallest value of each run of ``spread`` values inside a document, any one of equals.

    ``bounds`` are the documents' first positions; a document of fewer values gives its smallest.
    """
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    at, step = np.arange(len(values)), 1
    chance = mixed(at.astype(np.uint64))
    while step < spread:
        move = min(step, spread - step)
        if len(at) <= move:
            at = at[:0]
            break
        left, right = at[:-move], at[move:]
        a, b = values[left], values[right]
        # equals, as in a stuttering text, are thinned by their places
        at = np.where((b < a) | ((b == a) & (chance[right] < chance[left])), right, left)
        step += move
    length = np.diff(bounds)
    owner = np.repeat(np.arange(len(length)), length)
    inside = np.zeros(len(at), dtype=bool)
    if len(at):
        inside = owner[: len(at)] == owner[spread - 1 : spread - 1 + len(at)]
    chosen = [at[inside]]
    for d in np.flatnonzero((length > 0) & (length < spread)).tolist():
        chosen.append(np.array([bounds[d] + int(np.argmin(values[bounds[d] : bounds[d + 1]]))]))
    return np.unique(np.concatenate(chosen))


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc`` (null last), ``tag`` (the text's hash, so that a repeated or missing id is another document) and ``text``."""
    key = F.coalesce(F.col(f"`{doc}`").cast("long"), F.lit(2**63 - 1))
    return docs.select(key.alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("tag"), F.col(f"`{text}`").alias("text"))


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """``rolling`` for any width: long runs are differences of one running sum, whatever their width."""
    n = len(hashes) - width + 1
    if width <= 8 or n <= 0:
        return rolling(hashes, width)
    powers, back = np.full((2, len(hashes)), _STEP)
    back[:] = _STEP_BACK
    powers[0] = back[0] = 1
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * np.cumprod(powers, dtype=np.uint64), out=total[1:])
    # what a run adds is shifted back to its first word, modulo 2^64
    return mixed((total[width:] - total[:n]) * np.cumprod(back, dtype=np.uint64)[:n] + np.uint64(width))


def _seeds(keyed: DataFrame, size: int = SEED, apart: int = SPREAD) -> DataFrame:
    """(``seed``, ``doc``, ``tag``, ``at``) of runs of ``size`` words, one of each ``apart`` neighbours; ``n``: words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tag = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, last, buffer, offsets in slices(b.column(2)):
                w = words(buffer, offsets)
                runs = _runs(w.hashes(), size)
                count = np.maximum(np.diff(w.bounds) - size + 1, 0)
                owner = np.repeat(np.arange(len(count)), count)
                begin = np.cumsum(count) - count
                inner = np.arange(len(owner)) - begin[owner]
                values = runs[w.bounds[owner] + inner] if len(owner) else runs[:0]
                at = winnow(values, np.r_[begin, len(owner)], apart)
                who = owner[at] + first
                place = inner[at].astype(np.int32)
                length = np.diff(w.bounds)[owner[at]].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[at].view(np.int64)), pa.array(doc[who]), pa.array(tag[who]), pa.array(place), pa.array(length)],
                    names=["seed", "doc", "tag", "at", "n"],
                )
        give_back()

    return keyed.select("doc", "tag", "text").mapInArrow(run, "seed long, doc long, tag long, at int, n int")


def _asked(keyed: DataFrame, requests: DataFrame) -> DataFrame:
    """``keyed`` rows joined with the stored ``requests`` for them; where their keys are few, other texts are not shuffled."""
    keys = small(stored(requests.select("doc", "tag").distinct()))
    return keyed.join(keys, ["doc", "tag"], "left_semi").join(requests, ["doc", "tag"])


def _matches(keyed: DataFrame) -> DataFrame:
    """(``doc, tag, at, first_doc, first_tag, first_at``) of each occurrence of a repeated seed that is not its first."""
    seeds = _seeds(keyed).drop("n")
    met = seeds.join(_repeated(seeds), "seed")
    return met.where("doc != first_doc OR tag != first_tag OR at != first_at").drop("seed")


def _repeated(seeds: DataFrame) -> DataFrame:
    """(``seed, first_doc, first_tag, first_at``) of seeds that occur twice, written."""
    first = seeds.groupBy("seed").agg(F.min(F.struct("doc", "tag", "at")).alias("first"), F.count("*").alias("times"))
    names = [F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc", "tag", "at")]
    return stored(first.where("times > 1").select("seed", *names))


def chains(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Chains of matches ``(x, y)``, sorted by x and no x twice: indexes of strictly rising x and y, best chains first.

    A chain's score is ``GAIN`` a match less ``GAP`` for each word between
    neighbours on both sides; each match is in one chain.
    """
    n = len(x)
    levels, rank = np.unique(y, return_inverse=True)
    size = len(levels)
    tree_value, tree_index = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    shift = (GAP * (x + y)).tolist()
    for i, r in enumerate(rank.tolist()):
        best, who, k = float("-inf"), -1, r  # levels below r
        while k > 0:
            if tree_value[k] > best:
                best, who = tree_value[k], tree_index[k]
            k -= k & -k
        own = GAIN
        if who >= 0 and best - shift[i] > 0:
            own, back[i] = GAIN + best - shift[i], who
        score[i] = own
        k, value = r + 1, own + shift[i]
        while k <= size:
            if value > tree_value[k]:
                tree_value[k], tree_index[k] = value, i
            k += k & -k
    used, out = [False] * n, []
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def _chained(matches: DataFrame) -> DataFrame:
    """Chains as (``doc, tag, first_doc, first_tag, xs, ys``): word positions of the seeds on both sides."""
    keys = ["doc", "tag", "first_doc", "first_tag"]
    rows = matches.select(*keys, F.col("at").cast("long").alias("x"), F.col("first_at").cast("long").alias("y")).distinct()
    rows = spread(rows, *keys).sortWithinPartitions(*keys, "x")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held = np.zeros((6, 0), dtype=np.int64)
        for b in batches:
            held = np.hstack([held, np.array([c.to_numpy(zero_copy_only=False) for c in b.columns], dtype=np.int64)])
            cuts = np.flatnonzero((held[:4, 1:] != held[:4, :-1]).any(axis=0)) + 1
            for a, z in zip(np.r_[0, cuts[:-1]], cuts, strict=True) if len(cuts) else ():
                yield held[:, a:z]
            held = held[:, cuts[-1] :] if len(cuts) else held
        if held.shape[1]:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []

        def batch() -> pa.RecordBatch:
            names = [*keys, "xs", "ys"]
            types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2
            columns = zip(*out, strict=True) if out else [[]] * 6
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
            out.clear()
            return made

        for g in groups(batches):
            for c in chains(g[4], g[5]):
                if len(c) < LEAST_SEEDS:
                    continue
                out.append((*g[:4, 0].tolist(), g[4][c].tolist(), g[5][c].tolist()))
            if len(out) > 2000:
                yield batch()
        yield batch()

    return rows.mapInArrow(run, "doc long, tag long, first_doc long, first_tag long, xs array<int>, ys array<int>")


def _extend(a: np.ndarray, b: np.ndarray, drop: int = 6) -> tuple[int, int]:
    """Words from the start of ``a`` and ``b`` worth keeping, and how many of them are equal."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    worth = np.cumsum(np.where(same, 1, -2))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(worth, 0)) - worth > drop)
    upto = fallen[0] if len(fallen) else n
    best = int(np.argmax(worth[:upto])) if upto else 0
    return (best + 1, int(same[: best + 1].sum())) if upto and worth[best] > 0 else (0, 0)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two gaps."""
    if len(a) == len(b) or not len(a) or not len(b):
        same = int((a == b).sum()) if len(a) == len(b) else 0
        return same
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for word in a:
        step = np.where(b == word, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], step))
    return int(row[-1])


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[int, int, int, int, int]:
    """(from, to) in ``a``, (from, to) in ``b`` and equal words of the alignment through the seeds at ``xs`` and ``ys``."""
    equal, i, j = 0, int(xs[0]), int(ys[0])
    left, same = _extend(a[:i][::-1], b[:j][::-1])
    start, other, equal = i - left, j - left, same
    for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
        if x > i or y > j:
            equal += _common(a[i : max(x, i)], b[j : max(y, j)])
        fresh = max(0, min(x + SEED - max(i, x), y + SEED - max(j, y)))
        equal += fresh
        i, j = max(i, x + SEED), max(j, y + SEED)
    right, same = _extend(a[i:], b[j:])
    return start, i + right, other, j + right, equal + same


def _apart(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, shift: int) -> tuple[int, int, int, int, int]:
    """As ``align``, for two places of one document that meet: the earlier copy ends where the later one starts.

    ``shift`` is what a place in ``a`` is further to the front in ``b``.
    """
    start, _, other, _, _ = align(a, b, xs, ys)
    b = b[: start + shift]
    within = ys + SEED <= len(b)
    if within.any():
        return align(a, b, xs[within], ys[within])
    n = min(len(b) - other, len(a) - start)
    return start, start + n, other, other + n, int((a[start : start + n] == b[other : other + n]).sum())


def _rows(batch: pa.RecordBatch, at_once: int = 64) -> Iterator[tuple]:
    """Rows of ``batch`` as Python values, a few at a time: as objects they take many times their Arrow bytes."""
    for first in range(0, batch.num_rows, at_once):
        yield from zip(*(c.to_pylist() for c in batch.slice(first, at_once).columns), strict=True)


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(``asked``, ``text``) to (``chain, side, lo, cut``): the hashes of the words asked for.

    Batches end at about ``CUT_BYTES``, by the cuts and not by the rows: the first of many long copies is asked for whole, again and again.
    """
    names, types = ["chain", "side", "lo", "cut"], [pa.int64(), pa.string(), pa.int32(), pa.binary()]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    for b in batches:
        out: list[tuple] = []
        held = 0
        for i in range(b.num_rows):
            for _, _, buffer, offsets in slices(b.column(1).slice(i, 1)):
                hashes = words(buffer, offsets).hashes().astype(np.uint32)
            for r in b.column(0)[i].as_py():
                out.append((r["chain"], r["side"], r["lo"], hashes[r["lo"] : r["hi"]].tobytes()))
                held += len(out[-1][3])
                if held >= CUT_BYTES:
                    yield batch(out)
                    out, held = [], 0
        yield batch(out)
    give_back()


def _aligned(chained: DataFrame, keyed: DataFrame) -> DataFrame:
    """Parts (``doc, tag, start, end, first_doc, first_tag, first_start, first_end, equal``) of chains that align well."""
    side = lambda p, s: F.struct(
        F.lit(p).alias("side"),
        F.col("doc" if p == "a" else "first_doc").alias("doc"),
        F.col("tag" if p == "a" else "first_tag").alias("tag"),
        F.greatest(F.col(s)[0] - MARGIN, F.lit(0)).alias("lo"),
        (F.element_at(s, -1) + SEED + MARGIN).alias("hi"),
    )
    named = chained.withColumn("chain", F.xxhash64("doc", "tag", "first_doc", "first_tag", F.col("xs")[0], F.col("ys")[0]))
    named = stored(named)
    wanted = stored(named.select("chain", F.explode(F.array(side("a", "xs"), side("b", "ys"))).alias("w")).select("chain", "w.*"))
    # a text goes along once for each REQUESTS of its parts, also if thousands of chains end in it
    many = wanted.groupBy("doc", "tag").agg(F.count("*").alias("n")).where(F.col("n") > REQUESTS)
    lots = wanted.join(small(stored(many)), ["doc", "tag"], "left")
    lot = F.pmod(F.xxhash64("chain", "side"), F.coalesce(F.ceil(F.col("n") / REQUESTS), F.lit(1)))
    lots = lots.withColumn("lot", lot).groupBy("doc", "tag", "lot").agg(F.collect_list(F.struct("chain", "side", "lo", "hi")).alias("asked"))
    met = _asked(keyed, stored(lots)).select("asked", "text")

    parts = met.mapInArrow(_cuts, "chain long, side string, lo int, cut binary")
    a, b = F.when(F.col("side") == "a", F.struct("lo", "cut")), F.when(F.col("side") == "b", F.struct("lo", "cut"))
    pairs = parts.groupBy("chain").agg(F.max(a).alias("a"), F.max(b).alias("b"))
    ready = named.join(pairs, "chain").select("doc", "tag", "first_doc", "first_tag", "xs", "ys", "a.lo", F.col("a.cut").alias("ca"), F.col("b.lo").alias("lb"), F.col("b.cut").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t, fd, ft, xs, ys, lo, ca, lb, cb in _rows(batch):
                left, right = (np.frombuffer(c, dtype=np.uint32) for c in (ca, cb))
                xs, ys = np.array(xs) - lo, np.array(ys) - lb
                s, e, fs, fe, equal = align(left, right, xs, ys)
                long = e - s >= PART_WORDS
                if (d, t) == (fd, ft) and fe + lb > s + lo:
                    s, e, fs, fe, equal = _apart(left, right, xs, ys, lo - lb)
                n = max(e - s, fe - fs)
                if long and equal >= IDENTITY * n:
                    rows.append((d, t, s + lo, e + lo, fd, ft, fs + lb, fe + lb, equal))
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)
        give_back()

    names = ["doc", "tag", "start", "end", "first_doc", "first_tag", "first_start", "first_end", "equal"]
    return ready.mapInArrow(run, ", ".join(f"`{n}` long" for n in names))


def _covered(found: DataFrame) -> DataFrame:
    """(``doc``, ``tag``, ``spans``): the words of each document that parts cover, as spans that don't touch."""
    listed = found.groupBy("doc", "tag").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("p"))
    schema = "doc long, tag long, spans array<struct<start: long, end: long>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(2).to_pylist():
                spans: list[dict] = []
                for x in p:
                    if spans and x["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], x["end"])
                    else:
                        spans.append(x)
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc", "tag", "spans"])

    return listed.mapInArrow(run, schema)


def _whole_runs(keyed: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """Parts, as ``found``, of runs of ``min_words`` words that an earlier place has word for word and no passage in ``found`` covers.

    A run of one document that overlaps its own first occurrence is left out.
    """
    size = min(min_words, max(SEED, min_words - SPREAD + 1))
    apart = min_words - size + 1
    seeds = _seeds(keyed, size, apart)
    met = seeds.join(_repeated(seeds), "seed").withColumn("later", F.expr("doc != first_doc OR tag != first_tag OR at != first_at"))
    met = stored(met.select("seed", "doc", "tag", F.col("at").alias("p"), "n", "later"))
    spans = stored(_covered(found))
    # seeds of which some run around a later occurrence is not in a passage
    held = met.where("later").join(small(spans), ["doc", "tag"], "left")
    around = lambda s: (s["start"] <= F.greatest(F.col("p") - (apart - 1), F.lit(0))) & (s["end"] >= F.least(F.col("p") + min_words, "n"))
    bare = held.where(F.col("spans").isNull() | ~F.exists("spans", around))
    asked = met.join(small(stored(bare.select("seed").distinct())), "seed").groupBy("doc", "tag").agg(F.collect_set("p").alias("asked"))
    texts = _asked(keyed, stored(asked)).select("doc", "tag", "asked", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc, tag, asked = (b.column(k)[i].as_py() for k in range(3))
                for _, _, buffer, offsets in slices(b.column(3).slice(i, 1)):
                    runs = _runs(words(buffer, offsets).hashes(), min_words)
                x = np.unique(np.add.outer(np.array(asked), -np.arange(apart)))
                x = x[(x >= 0) & (x < len(runs))]
                columns = [runs[x].view(np.int64), np.full(len(x), doc), np.full(len(x), tag), x.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "doc", "tag", "at"])

    runs = stored(texts.mapInArrow(cut, "seed long, doc long, tag long, at long").distinct())
    twice = runs.join(small(_repeated(runs)), "seed").drop("seed")
    twice = twice.withColumnRenamed("at", "start").withColumnRenamed("first_at", "first_start")
    twice = twice.where(f"doc != first_doc OR tag != first_tag OR start >= first_start + {min_words}").join(small(spans), ["doc", "tag"], "left")
    inside = lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("start") + min_words)
    twice = twice.where(F.col("spans").isNull() | ~F.exists("spans", inside))
    listed = twice.groupBy("doc", "tag").agg(F.sort_array(F.collect_set(F.struct("start", "first_doc", "first_tag", "first_start"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t, p in _rows(batch):
                group: list[list[int]] = []
                for x in p:
                    s, other, f = x["start"], (x["first_doc"], x["first_tag"]), x["first_start"]
                    g = group[-1] if group else None
                    itself = other == (d, t)  # the earlier place ends before the later one starts
                    if g and g[4:] == [other] and s - g[0] == f - g[2] and s <= g[1] and not (itself and f + min_words > g[0]):
                        g[1], g[3] = s + min_words, f + min_words
                        continue
                    # a part between two that meet adds nothing
                    if len(group) > 1 and s <= group[-2][1]:
                        group.pop()
                    group.append([s, s + min_words, f, f + min_words, other])
                rows += [(d, t, s, e, other[0], f, fe, e - s) for s, e, f, fe, other in group]
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=_FOUND)

    return listed.mapInArrow(run, ", ".join(f"`{n}` long" for n in _FOUND))


#: Columns of parts of passages.
_FOUND = ["doc", "tag", "start", "end", "first_doc", "first_start", "first_end", "n_equal"]


def passages(docs: DataFrame, doc: str, text: str, min_words: int = 50) -> DataFrame:
    """Parts of repeated passages: ``doc``, ``start``, ``end``, ``first_`` document, start and end, ``n_equal``, ``tag``.

    Positions count words (runs outside ASCII white space, A-Z lower-cased)
    from 0, ``end`` excluded. A passage is a union of parts of a document that
    overlap or lie within ``BRIDGE`` words and has ``min_words`` words or
    more; each part names the earlier text it repeats: a document with a
    smaller id, or the same one further to the front (then only parts that add to the passage). The first occurrence is not
    listed. Ids are integers; a null id comes last. Rows with the same id and
    text are one document, with the same id and other texts several (told
    apart by ``tag``). Null, empty and short texts have no passages.
    """
    keyed = _keyed(docs, doc, text)
    parts = _aligned(_chained(_matches(keyed)), keyed)
    parts = parts.distinct()
    listed = parts.groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_doc", "first_start", "first_end", "equal"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t, p in _rows(batch):
                group, upto = [], None
                for x in [*p, None]:
                    if x is None or upto is None or x["start"] > upto + BRIDGE:
                        if group and upto - group[0]["start"] >= min_words:
                            rows += [(d, t, *g.values()) for g in group]
                        group, upto = [], 0
                    # inside itself a document often repeats the same words again and again
                    if x is not None and not (x["first_doc"] == d and x["end"] <= upto):
                        group.append(x)
                        upto = max(upto, x["end"])
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=_FOUND)

    found = stored(listed.mapInArrow(run, ", ".join(f"`{n}` long" for n in _FOUND)))
    found = found.unionByName(_whole_runs(keyed, found, min_words))
    back = lambda c: F.when(F.col(c) != 2**63 - 1, F.col(c))
    return found.select(back("doc").alias(doc), "start", "end", back("first_doc").alias(f"first_{doc}"), "first_start", "first_end", "n_equal", "tag")


def without_repeats(docs: DataFrame, doc: str, text: str, min_words: int = 50) -> DataFrame:
    """All columns of ``docs``, with repeated passages cut out of ``text`` (their first occurrence stays).

    White space around a cut becomes one newline. Rows whose text is nothing but repeats go;
    rows without repeats, null and empty texts included, are unchanged.
    """
    found = passages(docs, doc, text, min_words)
    spans = found.groupBy(doc, "tag").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    spans = stored(spans.select(F.col(f"`{doc}`").alias("__doc"), F.col("tag").alias("__tag"), "__spans"))
    tag = F.xxhash64(F.col(f"`{text}`"))
    same = F.col(f"`{doc}`").cast("long").eqNullSafe(F.col("__doc")) & (tag == F.col("__tag"))
    names, schema = docs.columns, docs.schema
    keys = stored(spans.select("__doc", "__tag"))
    if stored_bytes(keys) <= BROADCAST_BYTES:
        # only texts that are cut meet their spans, the others are not shuffled
        cut = docs.join(F.broadcast(keys), same, "left_semi").join(spans, same).drop("__doc", "__tag")
        rest = docs.join(F.broadcast(keys), same, "left_anti")
        met = cut.unionByName(rest.withColumn("__spans", F.lit(None).cast(spans.schema["__spans"].dataType)))
    else:
        met = docs.join(spans, same, "left").drop("__doc", "__tag")
    at, last = names.index(text), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(at), b.column(last)
            rows = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(rows):
                new = texts.to_pylist()
                for r in rows.tolist():
                    new[r] = _cut(new[r], [(s["start"], s["end"]) for s in spans[r].as_py()])
                texts = pa.array(new, texts.type)
            keep = np.ones(b.num_rows, dtype=bool)
            keep[[r for r in rows.tolist() if not new[r]]] = False
            columns = [texts if i == at else b.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return met.mapInArrow(run, schema)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    w = words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
    keep, upto = [], 0
    for s, e in [*spans, (len(w.starts), len(w.starts))]:
        if s > upto:
            keep.append(raw[w.starts[upto] : w.ends[s - 1]].decode())
        upto = max(upto, e)
    return "\n".join(keep)
