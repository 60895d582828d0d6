"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the
piece they would form, leftmost first among equals, and merges the best pair
until none forms a piece. A pair never merges across the start of a run of
word marks unless the vocabulary has a piece that holds a mark behind another
character, so a text falls into parts (marks, then other characters) that have
agendas of their own. The agendas of all parts that a batch has not seen
before advance together: in each round every part takes the head of its agenda
as a few NumPy operations over all of them.

The parts' ids and decoded texts are compared with the ``sentencepiece``
library, each distinct part once for each Arrow batch stream; a difference
raises. What is left over is only joining parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Distinct parts and text bytes that a task handles at once; neither limits what is encoded.
KNOWN_PARTS = 150_000
GROUP_BYTES = 1 << 20

_PART = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_ANY_PART = re.compile(r"(?s).+")
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class Vocabulary:
    """A model file: pieces, scores and the pairs that form pieces.

    Raises for models that are not of the merge type or that need text
    normalization, unused or user-defined pieces; those are other algorithms.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = [p.type for p in model.pieces]
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or train.treat_whitespace_as_suffix or not train.byte_fallback:
            raise ValueError("only merge-type vocabularies with byte fallback and leading word marks")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only vocabularies without text normalization")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined or unused pieces are not supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.texts = [p.piece for p in model.pieces]
        self.kinds = kinds
        self.unknown = [i for i, k in enumerate(kinds) if k == UNKNOWN]
        self.eos = self.library.eos_id()
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes_at = np.zeros(256, dtype=np.int64)
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.bytes_at[int(self.texts[i][1:-1], 16)] = i
        spelt = [
            bytes([int(t[1:-1], 16)]) if k == BYTE else {UNKNOWN: " ⁇ ", CONTROL: ""}.get(k, t.replace(MARK, " ")).encode()
            for t, k in zip(self.texts, kinds, strict=True)
        ]
        self.spelt = np.frombuffer(b"".join(spelt), dtype=np.uint8)
        self.spelt_at = np.r_[0, np.cumsum([len(x) for x in spelt])]
        # an inner mark would let pairs merge across parts
        inner = any(MARK in p.lstrip(MARK) for p in normal)
        self.part = _ANY_PART if inner else _PART
        # symbols are ids; characters outside the vocabulary get numbers above it
        self.chars = {p: i for p, (i, _) in normal.items() if len(p) == 1}
        for p in list(normal):
            for c in p:
                self.chars.setdefault(c, len(self.texts) + len(self.chars))
        symbol = {p: i for p, (i, _) in normal.items()} | self.chars
        order = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        pairs = [
            (symbol[p[:k]], symbol[p[k:]], order[score], i)
            for p, (i, score) in normal.items()
            for k in range(1, len(p))
            if p[:k] in symbol and p[k:] in symbol
        ]
        self.width = len(self.texts) + len(self.chars) + 1
        keys = np.array([a * self.width + b for a, b, _, _ in pairs], dtype=np.int64)
        by = np.argsort(keys)
        self.keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.none = len(order)
        self.rank = np.append(np.array([r for *_, r, _ in pairs], dtype=np.int32)[by], self.none)  # -1 reads the last
        self.made = np.append(np.array([i for *_, i in pairs], dtype=np.int64)[by], 0)

    def agenda(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Index into the pair table of the symbols ``at`` and ``at + 1``; -1 if they form no piece or belong to two parts."""
        after = np.minimum(at + 1, len(symbol) - 1)
        left, right = symbol[at], symbol[after]
        key = left * self.width + right
        found = np.searchsorted(self.keys, key)
        good = (self.keys[found] == key) & (owner[at] == owner[after]) & (after > at) & (left >= 0) & (right >= 0)
        return np.where(good, found, -1)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts (marks already in place, no prefix added) and how many each part has."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        # characters: known ones by table, others keep a number of their own
        seen, back = np.unique(codes, return_inverse=True)
        table = np.array([self.chars.get(chr(c), -1 - int(c)) for c in seen], dtype=np.int64)
        symbol = table[back] if len(seen) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(symbol), dtype=np.int32)
        pair = self.agenda(symbol, owner, np.arange(len(symbol))) if len(symbol) else symbol
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank = self.rank[pair]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(owner)])
            head = rank == np.repeat(best, size)
            finished = best == self.none
            if finished.any():  # their agenda is empty
                over = np.repeat(finished, size)
                done.append((owner[over], place[over], symbol[over]))
                on = ~over
                symbol, owner, place, pair, head = symbol[on], owner[on], place[on], pair[on], head[on]
                if not len(symbol):
                    break
            at = np.flatnonzero(head)
            at = at[np.r_[True, owner[at][1:] != owner[at][:-1]]]  # leftmost of each part
            symbol[at] = self.made[pair[at]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            symbol, owner, place, pair = symbol[keep], owner[keep], place[keep], pair[keep]
            at = at - np.arange(len(at))
            for changed in (at, at[at > 0] - 1):
                pair[changed] = self.agenda(symbol, owner, changed)
        if not done:
            return np.zeros(0, dtype=np.int32), np.zeros(len(parts), dtype=np.int64)
        owner, place, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(place, kind="stable")
        owner, symbol = owner[by], symbol[by]
        # single characters that are no piece become their bytes
        loose = np.flatnonzero((symbol < 0) | (symbol >= len(self.texts)))
        if len(loose):
            names = {v: k for k, v in self.chars.items() if v >= len(self.texts)}
            spelt = [self.bytes_at[list((chr(-1 - s) if s < 0 else names[s]).encode())] for s in symbol[loose].tolist()]
            times = np.ones(len(symbol), dtype=np.int64)
            times[loose] = [len(x) for x in spelt]
            times_loose = np.zeros(len(symbol), dtype=bool)
            times_loose[loose] = True
            owner, symbol = np.repeat(owner, times), np.repeat(symbol, times)
            symbol[np.repeat(times_loose, times)] = np.concatenate(spelt)
        return symbol.astype(np.int32), np.bincount(owner, minlength=len(parts))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """Texts of the id lists ``ids[at[d]:at[d+1]]``.

        Byte pieces spell bytes, marks are spaces, control ids are nothing and
        one leading mark goes if the model puts it there. Lists whose bytes
        are no UTF-8, or that hold unknown ids, go through ``decode_one``.
        """
        size = self.spelt_at[ids + 1] - self.spelt_at[ids]
        ends = np.r_[0, np.cumsum(size)]
        data = self.spelt[np.repeat(self.spelt_at[ids] - ends[:-1], size) + np.arange(ends[-1])]
        first, last = ends[at[:-1]], ends[at[1:]]
        if self.dummy_prefix and len(data):
            drop = (last > first) & (data[np.minimum(first, len(data) - 1)] == 32)
            keep = np.ones(len(data), dtype=bool)
            keep[first[drop]] = False
            data = data[keep]
            cut = np.cumsum(drop)
            bounds = np.r_[0, last - cut]
        else:
            bounds = ends[at]
        raw = data.tobytes()
        # no character may run from one list into the next
        begins = data[bounds[:-1][bounds[:-1] < len(data)]]
        if not np.isin(ids, self.unknown).any() and not np.any((begins & 0xC0) == 0x80) and _is_utf8(raw):
            offsets = pa.py_buffer(bounds.astype(np.int64).tobytes())
            return pa.LargeStringArray.from_buffers(len(at) - 1, offsets, pa.py_buffer(raw)).cast(pa.string())
        return pa.array([self.decode_one(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())

    def decode_one(self, ids: list[int]) -> str:
        """One list, with a replacement character for each byte that fits nowhere."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, self.eos]:
            if self.kinds[i] == BYTE:
                run.append(int(self.texts[i][1:-1], 16))
                continue
            out.append(_bytes_text(bytes(run)))
            run.clear()
            out.append(self.spelt[self.spelt_at[i] : self.spelt_at[i + 1]].tobytes().decode())
        text = "".join(out)
        first = next((self.kinds[i] for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if self.dummy_prefix and text.startswith(" ") and first != UNKNOWN else text


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _bytes_text(run: bytes) -> str:
    out, i = [], 0
    while i < len(run):
        for n in range(1, 5):
            try:
                out.append(run[i : i + n].decode())
            except UnicodeDecodeError:
                continue
            i += n
            break
        else:
            out.append("\ufffd")
            i += 1
    return "".join(out)


class Encoder:
    """Encodes texts with the parts seen so far; new parts are checked against the library."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.zeros(0, dtype=np.int32)
        self.first = np.zeros(1, dtype=np.int64)

    def learn(self, new: list[str]) -> None:
        ids, sizes = self.v.encode_parts(new)
        self.check(new, ids, sizes)
        self.index.update(zip(new, range(len(self.first) - 1, len(self.first) - 1 + len(new)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.pool = np.concatenate([self.pool, ids])

    def check(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of each new part, by the library; a difference raises."""
        # a part as a text of its own: the library puts the first mark back
        prefix = self.v.dummy_prefix
        own = np.array([not prefix or (p[0] == MARK and len(p) > 1) for p in new])
        texts = [p[1:] if prefix else p for p, o in zip(new, own, strict=True) if o]
        theirs = self.v.library.encode(texts, num_threads=1)
        flat = np.fromiter(chain.from_iterable(theirs), dtype=np.int32)
        if not np.array_equal(flat, ids[np.repeat(own, sizes)]):
            ends = np.cumsum(sizes[own])
            at = ids[np.repeat(own, sizes)]
            wrong = [t for t, a, e, n in zip(texts, theirs, ends, sizes[own], strict=True) if a != at[e - n : e].tolist()]
            raise AssertionError(f"encoding differs from the library's for {wrong[:1]!r}")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets); a non-empty text gets the model's prefix, an empty one has no ids."""
        prefix = MARK if self.v.dummy_prefix else ""
        split = [self.v.part.findall(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.index) > KNOWN_PARTS:
            self.forget()
        new = sorted(set(chain.from_iterable(split)) - self.index.keys())
        if new:
            self.learn(new)
        parts = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        per = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        size = self.first[parts + 1] - self.first[parts]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.first[parts] - (ends - size), size) + np.arange(total)]
        return ids, np.r_[0, ends][np.r_[0, np.cumsum(per)]]


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """The model, read once a worker."""
    return Vocabulary(path)


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + GROUP_BYTES)))
        yield first, texts.slice(first, last - first).to_pylist()
        first = last


def encode(df: DataFrame, text: str, path: str, ids: str = "ids", end: bool = True) -> DataFrame:
    """All rows and columns of ``df`` but ``text``, and ``ids`` (array of int) of the whole text.

    A null text counts as empty: only the end id, if asked for. Spaces inside
    are kept as they are. A column of ``df`` called ``ids`` is replaced. Rows keep their order; no shuffle.
    """
    kept = [c for c in df.columns if c not in (text, ids)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = source.select(*[F.col(f"`{c}`") for c in kept]).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            for first, texts in _groups(b.column(len(kept)).fill_null("")):
                found, at = encoder.encode(texts)
                if end:
                    found = np.insert(found, at[1:], encoder.v.eos)
                    at = at + np.arange(len(at))
                out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int32()))
                rest = b.slice(first, len(texts)).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*rest, out], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, path: str, text: str = "decoded") -> DataFrame:
    """All rows and columns of ``df`` and ``text``: the whole decoded text of ``ids``, as the library's ``decode`` gives it.

    Null or empty ids give an empty text. A column of ``df`` called ``text`` is replaced.
    """
    kept = [c for c in df.columns if c != text]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("__ids"))
    schema = source.select(*[F.col(f"`{c}`") for c in kept]).schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            lists = b.column(len(kept))
            sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            first = 0
            while first < len(lists):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + GROUP_BYTES // 4)))
                flat = lists.slice(first, last - first).flatten().to_numpy(zero_copy_only=False)
                out = v.decode(flat, np.r_[0, np.cumsum(sizes[first:last])])
                rest = b.slice(first, last - first).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*rest, out], names=schema.fieldNames())
                first = last

    return source.mapInArrow(run, schema)


def recode(df: DataFrame, text: str, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` (with the end id) and ``decode`` in one pass: one worker and one model a task."""
    kept = [c for c in df.columns if c not in (text, ids, decoded)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = source.select(*[F.col(f"`{c}`") for c in kept]).schema.add(ids, T.ArrayType(T.IntegerType())).add(decoded, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            for first, texts in _groups(b.column(len(kept)).fill_null("")):
                found, at = encoder.encode(texts)
                found = np.insert(found, at[1:], encoder.v.eos)
                at = at + np.arange(len(at))
                out = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int32())), encoder.v.decode(found, at)]
                rest = b.slice(first, len(texts)).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*rest, *out], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list[Column]:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the two results above."""
    i = F.col(f"`{ids}`")
    return [
        F.size(i).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(i.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(f"`{decoded}`"), 256).alias("decoded_sha256"),
    ]
