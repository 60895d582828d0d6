"""Language-model scores of texts by a Katz backoff model of word pairs.

    P(w | h) = d(c) c / (c(h) + R)      if the pair (h, w) occurs c > 0 times in training texts,
               alpha(h) P(w)            else (alpha is 1 for an unknown h)
    P(w)     = d(c) c / (N + R)         for a known word, and what is left of 1 for all unknown ones together

d are Good-Turing discounts of counts up to ``CUT``, R a tenth of a count that
each history keeps back, so that something is always left for what is new.
alpha(h) is exactly what the seen followers of h leave of 1, divided by what
they leave of the lower order; the sums run over all seen pairs.

Tokens are hashed in Arrow batches. A batch sends each of its distinct pairs
once, with the documents it occurs in, to the pair's partition: that of its
history, or of the whole pair if the history is a hot word. A partition so
has all that a history needs: it counts, keeps its part of the pair table, and
returns what is known of each document's sum. Pairs that were not seen in
training wait for alpha and for the counts of their words, which partitions ask
from each other, each distinct word once. Sums of hot histories are added up
over their partitions at the end.

Every text, word and pair is used; partitions hold ``GROUP_TOKENS`` tokens whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraframe.llm.storage import give_back, stored
from terraframe.llm.words import mixed, slices, words

#: Counts up to this are discounted; the share of a count kept back for new followers.
CUT, RESERVE = 5, 0.1
#: Tokens and documents of a batch, tokens of a partition.
BATCH_TOKENS, BATCH_DOCS, GROUP_TOKENS = 1_200_000, 30_000, 3_000_000
#: Ranges of histories in which a partition is counted, one after the other.
PIECES = 16
#: A word with clearly more than one in so many training tokens is hot; there are fewer than twice as many hot words.
HOT = 1000

_BEGIN, _END = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


class Tokens:
    """Pairs of a run of documents: history, word and document of each token (the end is a token)."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        docs = len(bounds) - 1
        self.n = np.diff(bounds) + 1
        self.word = np.insert(hashes, bounds[1:], _END)
        self.history = np.empty_like(self.word)
        self.history[1:] = self.word[:-1]
        self.history[bounds[:-1] + np.arange(docs)] = _BEGIN
        self.doc = np.repeat(np.arange(docs), self.n)


def _read(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    for b in batches:
        for first, last, buffer, offsets in slices(b.column(text)):
            for a in range(0, last - first, BATCH_DOCS):
                w = words(buffer, offsets[a : a + BATCH_DOCS + 1])
                # the bounds of ``words`` count from the first word of the whole buffer
                z = w.bounds
                keep = slice(int(z[0]), int(z[-1]))
                yield b.slice(first + a, len(z) - 1), Tokens(w.hashes()[keep], z - z[0])


def bucket(values: np.ndarray, n: int) -> np.ndarray:
    return ((mixed(values) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _hot_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Hot words (sorted) with their exact training counts, training tokens, all tokens. ``docs``: ``train, text``.

    Only words with more than a ``HOT``-th of a batch, fewer than ``HOT`` of them, are added up, and those with half that
    share of all tokens are then counted exactly: every word with more than 1.5 / ``HOT`` of all tokens is among them.
    Which words are hot says where their pairs go, and changes no result.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in _read(batches, 1):
            train = b.column(0).to_numpy(zero_copy_only=False)
            found, n = np.unique(t.history[train[t.doc]], return_counts=True)
            total = int(n.sum())
            often = n * HOT > total
            word = pa.array([*found[often].view(np.int64).tolist(), None, None], pa.int64())
            count = [*n[often].tolist(), total, len(t.doc)]
            role = [0] * int(often.sum()) + [1, 2]
            yield pa.RecordBatch.from_arrays([pa.array(role), word, pa.array(count)], names=["role", "word", "n"])
        give_back()

    seen = docs.mapInArrow(candidates, "role long, word long, n long").groupBy("role", "word").agg(F.sum("n").alias("n"))
    seen = stored(seen)
    totals = {r["role"]: r["n"] for r in seen.where("role > 0").collect()}
    n, tokens = totals.get(1, 0), totals.get(2, 0)
    hot = seen.where((F.col("role") == 0) & (F.col("n") * (2 * HOT) > n)).select("word").collect()  # fewer than 2 HOT
    hot = np.sort(np.array([r["word"] for r in hot], dtype=np.int64).view(np.uint64))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(hot), dtype=np.int64)
        for b, t in _read(batches, 1):
            h = t.history[b.column(0).to_numpy(zero_copy_only=False)[t.doc]]
            at = np.searchsorted(hot, h)
            good = at < len(hot)
            good[good] = hot[at[good]] == h[good]
            count += np.bincount(at[good], minlength=len(hot))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hot))), pa.array(count)], names=["i", "n"])

    counts = np.zeros(len(hot), dtype=np.int64)
    if len(hot):
        for r in docs.mapInArrow(exact, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            counts[r["i"]] = r["n"]
    return hot, counts, n, tokens


def _find(hot: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in ``hot``, -1 if it has none."""
    if not len(hot):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
    return np.where(hot[at] == values, at, -1)


def _packets(docs: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """One row for each batch and partition: the batch's distinct pairs there, with their documents. ``docs``: ``id, train, text``."""
    schema = T.StructType()
    for name in ("p", "part", "batch"):
        schema = schema.add(name, "long")
    for name in ("history", "followers", "word", "times", "docs", "train"):
        schema = schema.add(name, T.BinaryType())
    schema = schema.add("ids", T.ArrayType(docs.schema["id"].dataType)).add("n_tokens", T.ArrayType(T.LongType()))
    names = schema.fieldNames()

    def packed(number: int, ids: list[pa.Array], train: np.ndarray, tokens: list[Tokens]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        starts = np.cumsum([0] + [len(t.n) for t in tokens[:-1]])
        h, w = np.concatenate([t.history for t in tokens]), np.concatenate([t.word for t in tokens])
        doc = np.concatenate([(t.doc + s).astype(np.uint16) for t, s in zip(tokens, starts.tolist(), strict=True)])
        n_tokens = np.concatenate([t.n for t in tokens])
        tokens.clear()
        p = bucket(np.where(_find(hot, h) >= 0, h ^ mixed(w), h), parts)
        order = np.lexsort((w, h, p))
        p, h, w, doc = p[order], h[order], w[order], doc[order]
        del order
        new_h = np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])]
        first = np.flatnonzero(np.r_[True, new_h[1:] | (w[1:] != w[:-1])])
        times = np.diff(np.r_[first, len(h)]).astype(np.int32)
        h_first = np.flatnonzero(new_h[first])  # in pairs
        followers = np.diff(np.r_[h_first, len(first)]).astype(np.int32)
        at = np.searchsorted(p, np.arange(parts + 1))  # in tokens
        at_pair = np.searchsorted(first, at)
        at_h = np.searchsorted(h_first, at_pair)
        home = (part + number) % parts
        for q in range(parts):
            pairs, hs = slice(at_pair[q], at_pair[q + 1]), slice(at_h[q], at_h[q + 1])
            if at[q] == at[q + 1] and q != home:
                continue
            pieces = (h[first[h_first[hs]]], followers[hs], w[first[pairs]], times[pairs], doc[at[q] : at[q + 1]], train)
            own = (pa.concat_arrays(ids).to_pylist(), n_tokens.tolist()) if q == home else (None, None)
            row = [[q], [part], [number], *[[x.tobytes()] for x in pieces], [own[0]], [own[1]]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, train, tokens = 0, [], [], []
        for b, t in _read(batches, 2):
            if tokens and (sum(len(x.doc) for x in tokens) + len(t.doc) > BATCH_TOKENS or sum(map(len, ids)) + b.num_rows > BATCH_DOCS):
                yield from packed(number, ids, np.concatenate(train), tokens)
                number, ids, train, tokens = number + 1, [], [], []
            ids.append(b.column(0))
            train.append(b.column(1).to_numpy(zero_copy_only=False))
            tokens.append(t)
        if tokens:
            yield from packed(number, ids, np.concatenate(train), tokens)
        give_back()

    return docs.select("id", "train", "text").mapInArrow(run, schema)


def _array(cell, kind) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype=kind) if cell.is_valid else np.zeros(0, dtype=kind)


class _Packet:
    """Pairs of one batch in one partition, by history."""

    def __init__(self, cells: dict):
        self.history, self.followers = _array(cells["history"], np.uint64), _array(cells["followers"], np.int32)
        self.word, self.times = _array(cells["word"], np.uint64), _array(cells["times"], np.int32)
        self.docs, self.train = _array(cells["docs"], np.uint16), _array(cells["train"], np.bool_)
        self.pair_at = np.r_[0, np.cumsum(self.followers, dtype=np.int64)]
        self.token_at = np.r_[0, np.cumsum(self.times, dtype=np.int64)]

    def part(self, first: int, last: int) -> tuple[np.ndarray, ...]:
        """history and word of each pair of some histories, times, documents, and times in training."""
        a, z = self.pair_at[first], self.pair_at[last]
        history = np.repeat(self.history[first:last], self.followers[first:last])
        times, docs = self.times[a:z], self.docs[self.token_at[a] : self.token_at[z]]
        trained = np.bincount(np.repeat(np.arange(z - a), times), weights=self.train[docs], minlength=z - a)
        return history, self.word[a:z], times, docs, trained


#: What a partition returns for the documents ``docs`` of one batch. ``sums``: log10 of what histories occur (with RESERVE), for all
#: tokens and for those of new pairs, and log10 of the counts of pairs beyond CUT. ``counts``: known tokens, pairs with counts 1 to CUT.
_DOC_FIELDS = "part long, batch long, docs binary, sums binary, counts binary"
_TABLE_FIELDS = "history binary, followers binary, word binary, count binary, new_part binary, new_batch binary, new_doc binary, new_history binary, new_word binary, by_count array<long>"


def _count(packets: DataFrame, hot: np.ndarray, hot_counts: np.ndarray) -> DataFrame:
    """For each partition its part of the pair table (a row with ``by_count``), and what it knows of each batch's documents."""
    ids = packets.schema["ids"].dataType.simpleString()
    schema = f"p long, {_DOC_FIELDS}, ids {ids}, n_tokens array<long>, {_TABLE_FIELDS}"

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.num_rows
        col = {n: t.column(n) for n in t.column_names}
        sent = [_Packet({n: col[n][i] for n in ("history", "followers", "word", "times", "docs", "train")}) for i in range(rows)]
        sums = [np.zeros((len(x.train), 3)) for x in sent]
        counts = [np.zeros((len(x.train), 1 + CUT), dtype=np.int32) for x in sent]
        table: list[list[np.ndarray]] = [[] for _ in range(4)]
        new: list[list[np.ndarray]] = [[] for _ in range(5)]
        by_count = np.zeros(CUT + 1, dtype=np.int64)
        ends = [int(i * 2**64 // PIECES) for i in range(1, PIECES)]
        cuts = [np.r_[0, np.searchsorted(x.history, np.array(ends, dtype=np.uint64)), len(x.history)] for x in sent]
        for piece in range(PIECES):  # ranges of histories, one after the other: a group needs memory for one
            parts = [x.part(z[piece], z[piece + 1]) for x, z in zip(sent, cuts, strict=True)]
            h, w = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            trained = np.concatenate([x[4] for x in parts])
            order = np.lexsort((w, h))
            h, w = h[order], w[order]
            lead = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])] if len(h) else np.zeros(0, dtype=bool)
            group = np.empty(len(h), dtype=np.int32)
            group[order] = np.cumsum(lead) - 1
            gh, gw = h[lead], w[lead]
            del h, w, order, lead
            c = np.rint(np.bincount(group, weights=trained, minlength=len(gh))).astype(np.int64)
            own, of = np.unique(gh, return_inverse=True)
            total = np.rint(np.bincount(of, weights=c, minlength=len(own))).astype(np.int64)
            place = _find(hot, own)
            total[place >= 0] = hot_counts[place[place >= 0]]
            ch = total[of]
            log_h = np.log10(ch + RESERVE)
            log_new = np.where(c == 0, log_h, 0.0)
            log_often = np.where(c > CUT, np.log10(np.maximum(c, 1)), 0.0)
            first = 0
            for i, (ph, _, times, d, _) in enumerate(parts):
                g = np.repeat(group[first : first + len(ph)], times)  # of each token
                first += len(ph)
                n = len(sent[i].train)
                for k, x in enumerate((log_h, log_new, log_often)):
                    if x.any():
                        sums[i][:, k] += np.bincount(d, weights=x[g], minlength=n)
                counts[i][:, 0] += np.bincount(d[ch[g] > 0], minlength=n).astype(np.int32)
                few = c[g]
                for r in range(1, CUT + 1):
                    counts[i][:, r] += np.bincount(d[few == r], minlength=n).astype(np.int32)
                rest = few == 0
                m = int(rest.sum())
                place_of = (col["part"][i].as_py(), col["batch"][i].as_py())
                for out, x in zip(new, (np.full(m, place_of[0]), np.full(m, place_of[1]), d[rest], gh[g[rest]], gw[g[rest]]), strict=True):
                    out.append(x)
            seen = c > 0
            by_count += np.bincount(np.minimum(c[seen], CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
            own, followers = np.unique(gh[seen], return_counts=True)
            for out, x in zip(table, (own, followers.astype(np.int32), gw[seen], c[seen]), strict=True):
                out.append(x)
        out = []
        for i in range(rows):
            at = np.flatnonzero(sums[i].any(axis=1) | counts[i].any(axis=1))
            out.append((col["part"][i].as_py(), col["batch"][i].as_py(), at.astype(np.uint16), sums[i][at], counts[i][at]))
        names = [f.split()[0] for f in _TABLE_FIELDS.split(", ")]
        kinds = [pa.binary()] * 9 + [pa.list_(pa.int64())]
        columns = {
            "p": pa.array([key[0].as_py()] * (rows + 1), pa.int64()),
            "part": pa.array([x[0] for x in out] + [None], pa.int64()),
            "batch": pa.array([x[1] for x in out] + [None], pa.int64()),
            "docs": pa.array([x[2].tobytes() for x in out] + [None], pa.binary()),
            # column by column: most of it is zeros
            "sums": pa.array([x[3].tobytes(order="F") for x in out] + [None], pa.binary()),
            "counts": pa.array([x[4].tobytes(order="F") for x in out] + [None], pa.binary()),
            "ids": pa.chunked_array([*col["ids"].chunks, pa.nulls(1, col["ids"].type)]),
            "n_tokens": pa.chunked_array([*col["n_tokens"].chunks, pa.nulls(1, col["n_tokens"].type)]),
        }
        cells = [np.concatenate(x).tobytes() for x in (*table, *new)] + [by_count.tolist()]
        columns |= {n: pa.array([None] * rows + [x], k) for n, x, k in zip(names, cells, kinds, strict=True)}
        del sent, sums, counts, table, new, cuts, out, cells
        give_back()
        return pa.table(columns)

    return packets.groupBy("p").applyInArrow(run, schema)


def discounts(by_count: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 1, 2, ... from the numbers of types with counts 1 to ``CUT`` + 1.

    Where these give no values between 0 and 1, fewer counts are discounted;
    where not even that works, half a count is taken from each up to ``CUT``.
    """
    n = np.array([0, *by_count], dtype=float)
    for cut in range(CUT, 0, -1):
        if not (n[1 : cut + 2] > 0).all():
            continue
        common = (cut + 1) * n[cut + 1] / n[1]
        r = np.arange(1, cut + 1)
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else np.zeros(cut)
        if (d > 0).all() and (d < 1).all():
            return np.r_[d, np.ones(CUT - cut)]
    return 1 - 0.5 / np.arange(1, CUT + 1)


class Lower:
    """The lower order: probabilities of words by their training counts; ``types``: words with counts 1 to ``CUT`` + 1."""

    def __init__(self, types: list[int], tokens: int):
        self.d, self.tokens = discounts(types), tokens
        lost = ((1 - self.d) * np.arange(1, CUT + 1) * np.array(types[:CUT])).sum()
        self.unknown = 1 - (tokens - lost) / (tokens + RESERVE)

    def p(self, c: np.ndarray) -> np.ndarray:
        d = np.r_[0.0, self.d][np.minimum(c, CUT)]
        return np.where(c == 0, self.unknown, np.where(c <= CUT, d, 1.0) * c / (self.tokens + RESERVE))


def _wanted(r: dict) -> np.ndarray:
    """Distinct words whose counts a partition needs."""
    return np.unique(_counted(np.concatenate([_array(r["word"], np.uint64), _array(r["new_word"], np.uint64)])))


def _counted(w: np.ndarray) -> np.ndarray:
    """Words under the name of the history that has their count: the end occurs as often as the beginning."""
    return np.where(w == _END, _BEGIN, w)


def _answers(tables: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """(``p, u, count``): the training counts of the words that ``p`` asks from ``u``, in their order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w = _wanted({n: b.column(n)[i] for n in ("word", "new_word")})
                w = w[_find(hot, w) < 0]
                u = bucket(w, parts)
                order = np.argsort(u, kind="stable")
                names, at = np.unique(u[order], return_index=True)
                cells = [x.tobytes() for x in np.split(w[order], at[1:])] if len(names) else []
                columns = [pa.array(np.full(len(names), b.column("p")[i].as_py())), pa.array(names.astype(np.int64)), pa.array(cells, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["p", "u", "asked"])
            del b
            give_back()

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        own, c = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        if table.num_rows:
            own, c = _histories({n: table.column(n)[0] for n in ("history", "followers", "count")})
        cells = []
        for cell in asked.column("asked"):
            at = _find(own, _array(cell, np.uint64))
            cells.append(np.where(at >= 0, np.r_[c, 0][at], 0).tobytes())
        del own, c
        give_back()
        return pa.table({"p": asked.column("p"), "u": asked.column("u"), "count": pa.array(cells, pa.binary())})

    asked = tables.select("p", "word", "new_word").mapInArrow(ask, "p long, u long, asked binary")
    known = tables.select(F.col("p").alias("u"), "history", "followers", "count")
    return asked.groupBy("u").cogroup(known.groupBy("u")).applyInArrow(answer, "p long, u long, count binary")


def _histories(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Histories of a partition and the training counts it has of them."""
    own, f, c = _array(r["history"], np.uint64), _array(r["followers"], np.int32), _array(r["count"], np.int64)
    return own, np.add.reduceat(c, np.cumsum(f) - f) if len(own) else c


_WEIGHTS = "p long, history binary, alpha binary, hot binary, used binary, lower binary"


def _weights(tables: DataFrame, answers: DataFrame, hot: np.ndarray, hot_counts: np.ndarray, lower: Lower, d: np.ndarray, parts: int) -> DataFrame:
    """Backoff weights of each partition's histories, the sums of hot ones, and what the new pairs add to each batch's documents."""
    schema = f"{_WEIGHTS}, {_DOC_FIELDS}, hot_docs binary, hot_words binary"

    def run(key: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        r = {n: table.column(n)[0] for n in table.column_names}
        wanted = _wanted(r)
        count = np.zeros(len(wanted), dtype=np.int64)
        place = _find(hot, wanted)
        count[place >= 0] = hot_counts[place[place >= 0]]
        u = np.where(place < 0, bucket(wanted, parts), -1)
        for i in range(given.num_rows):
            count[u == given.column("u")[i].as_py()] = _array(given.column("count")[i], np.int64)
        p_of = lower.p(count)
        own, total = _histories(r)
        place = _find(hot, own)
        total = np.where(place >= 0, np.r_[hot_counts, 0][place], total)
        f, c = _array(r["followers"], np.int32), _array(r["count"], np.int64)
        of = np.repeat(np.arange(len(own)), f)
        share = np.where(c <= CUT, np.r_[0.0, d][np.minimum(c, CUT)], 1.0) * c / (total[of] + RESERVE)
        used = np.bincount(of, weights=share, minlength=len(own))
        below = np.bincount(of, weights=p_of[np.searchsorted(wanted, _counted(_array(r["word"], np.uint64)))], minlength=len(own))
        alpha = np.where(place >= 0, 1.0, (1 - used) / (1 - below))
        h, w = _array(r["new_history"], np.uint64), _array(r["new_word"], np.uint64)
        part, batch, doc = _array(r["new_part"], np.int64), _array(r["new_batch"], np.int64), _array(r["new_doc"], np.uint16)
        at = _find(own, h)
        value = np.log10(p_of[np.searchsorted(wanted, _counted(w))]) + np.log10(np.r_[alpha, 1.0][at])  # -1: an unknown history
        hot_at = _find(hot, h)
        order = np.lexsort((batch, part))
        cut = np.flatnonzero(np.r_[True, (np.diff(part[order]) != 0) | (np.diff(batch[order]) != 0)]) if len(h) else []
        out = []
        for rows in np.split(order, cut[1:]) if len(h) else []:
            docs, inverse = np.unique(doc[rows], return_inverse=True)
            added = np.bincount(inverse, weights=value[rows])
            sums = added
            late = rows[hot_at[rows] >= 0]
            out.append((int(part[rows[0]]), int(batch[rows[0]]), docs, sums, doc[late], hot_at[late].astype(np.int32)))
        n = len(out)
        mine = place >= 0
        cells = [own, alpha, place[mine].astype(np.int64), used[mine], below[mine]]
        columns = {"p": pa.array([key[0].as_py()] * (n + 1), pa.int64())}
        columns |= {k: pa.array([x.tobytes()] + [None] * n, pa.binary()) for k, x in zip(("history", "alpha", "hot", "used", "lower"), cells, strict=True)}
        columns |= {"part": pa.array([None] + [x[0] for x in out], pa.int64()), "batch": pa.array([None] + [x[1] for x in out], pa.int64())}
        columns |= {k: pa.array([None] + [x[i].tobytes() for x in out], pa.binary()) for k, i in (("docs", 2), ("sums", 3))}
        columns |= {"counts": pa.nulls(n + 1, pa.binary())}
        columns |= {k: pa.array([None] + [x[i].tobytes() for x in out], pa.binary()) for k, i in (("hot_docs", 4), ("hot_words", 5))}
        del r, wanted, count, u, p_of, f, c, of, share, h, w, part, batch, doc, at, value, order, cells, out
        give_back()
        return pa.table(columns)

    one = tables.select("p", "history", "followers", "word", "count", "new_part", "new_batch", "new_doc", "new_history", "new_word")
    return one.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(run, schema)


def _hot_alpha(weights: DataFrame, n: int) -> np.ndarray:
    """Backoff weights of the hot words, from the sums of all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, below = np.zeros(n), np.zeros(n)
        for b in batches:
            for i in range(b.num_rows):
                at = _array(b.column("hot")[i], np.int64)
                used[at] += _array(b.column("used")[i], np.float64)
                below[at] += _array(b.column("lower")[i], np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(used), pa.array(below)], names=["i", "used", "lower"])

    rows = weights.where("hot IS NOT NULL").select("hot", "used", "lower").mapInArrow(run, "i long, used double, lower double")
    alpha = np.ones(n)
    for r in rows.groupBy("i").agg(F.sum("used").alias("used"), F.sum("lower").alias("lower")).collect():  # one a hot word
        alpha[r["i"]] = (1 - r["used"]) / (1 - r["lower"])
    return alpha


def _texts(pieces: DataFrame, hot_log: np.ndarray, log_d: np.ndarray, log_total: float) -> DataFrame:
    """One row a document from what all partitions return for its batch."""
    ids = pieces.schema["ids"].dataType.elementType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        own = next(i for i in range(t.num_rows) if t.column("n_tokens")[i].is_valid)
        n_tokens = t.column("n_tokens")[own].values.to_numpy()
        n = len(n_tokens)
        sums, counts, added = np.zeros((n, 3)), np.zeros((n, 1 + CUT), dtype=np.int64), np.zeros(n)
        for i in range(t.num_rows):
            at = _array(t.column("docs")[i], np.uint16)
            if t.column("counts")[i].is_valid:
                sums[at] += _array(t.column("sums")[i], np.float64).reshape(3, -1).T
                counts[at] += _array(t.column("counts")[i], np.int32).reshape(1 + CUT, -1).T
            else:
                added[at] += _array(t.column("sums")[i], np.float64)
            late = _array(t.column("hot_docs")[i], np.uint16)
            if len(late):
                added += np.bincount(late, weights=hot_log[_array(t.column("hot_words")[i], np.int32)], minlength=n)
        # seen pairs: log10(d c) - log10(c(h) + R); new ones were added by the partitions
        score = added + sums[:, 2] + counts[:, 1:] @ (log_d + np.log10(np.arange(1, CUT + 1))) - (sums[:, 0] - sums[:, 1])
        columns = [t.column("ids")[own].values, n_tokens, counts[:, 0], sums[:, 0] - n_tokens * log_total, score]
        del sums, counts, added
        give_back()
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["id", "n_tokens", "n_known", "base_score", "score"])

    schema = f"id {ids}, n_tokens long, n_known long, base_score double, score double"
    return pieces.groupBy("part", "batch").applyInArrow(run, schema)


def score(docs: DataFrame, doc: str, text: str, train: Column) -> DataFrame:
    """``doc, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``; logarithms are to base 10.

    Words are runs outside ASCII white space, A-Z lower-cased; the end of a
    text is a token, its beginning a history. The model learns from the rows
    where ``train`` (a column over ``docs``; null is false) holds.
    base_score: of the single tokens with a tenth of a count added to each.
    A null text is empty: one token, its end. Repeated rows give repeated
    rows and are counted each time; nulls in ``doc`` are kept. Without any
    training text every token is unknown and both scores are 0.
    """
    held = F.coalesce(train, F.lit(False))
    rows = docs.select(F.col(f"`{doc}`").alias("id"), held.alias("train"), F.col(f"`{text}`").cast("string").alias("text"))
    hot, hot_counts, n, tokens = _hot_words(rows.select("train", "text"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-tokens // GROUP_TOKENS))
    counted = stored(_count(_packets(rows, hot, parts), hot, hot_counts))
    tables = counted.where("by_count IS NOT NULL")
    by_count = tables.select([F.sum(F.col("by_count")[i]).alias(f"n{i}") for i in range(CUT + 1)]).first()

    def types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CUT + 2, dtype=np.int64)
        for b in batches:
            for i in range(b.num_rows):
                own, c = _histories({k: b.column(k)[i] for k in ("history", "followers", "count")})
                c = c[_find(hot, own) < 0]
                out += np.r_[np.bincount(np.minimum(c, CUT + 2), minlength=CUT + 3)[1 : CUT + 2], len(c)]
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CUT + 2)), pa.array(out)], names=["i", "n"])

    known = np.bincount(np.minimum(hot_counts, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist() + [int((hot_counts > 0).sum())]
    for r in tables.select("history", "followers", "count").mapInArrow(types, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        known[r["i"]] += r["n"]
    *word_types, vocabulary = known
    lower, d = Lower(word_types, n), discounts([x or 0 for x in by_count])
    weights = stored(_weights(tables, _answers(tables, hot, parts), hot, hot_counts, lower, d, parts))
    hot_log = np.log10(_hot_alpha(weights, len(hot)))
    columns = ["part", "batch", "docs", "sums", "counts", "ids", "n_tokens", "hot_docs", "hot_words"]
    pieces = counted.where("by_count IS NULL").withColumns({"hot_docs": F.lit(None).cast("binary"), "hot_words": F.lit(None).cast("binary")})
    later = weights.where("part IS NOT NULL").withColumns(
        {"ids": F.lit(None).cast(counted.schema["ids"].dataType), "n_tokens": F.lit(None).cast("array<long>")}
    )
    pieces = pieces.select(columns).unionByName(later.select(columns))
    out = _texts(pieces, hot_log, np.log10(d), float(np.log10(n + RESERVE * (vocabulary + 1))))
    return out.select(F.col("id").alias(doc), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
