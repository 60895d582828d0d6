"""Wildcard URL rules, all simulated at once by a bit-parallel automaton.

Every rule is a glob over the canonical URL ``.host<00>path`` (host with A-Z
lower-cased and a leading dot, so that a host rule ``*.name`` also fits the
name itself). ``*`` is any run of bytes, ``?`` is one byte. The globs are packed one behind the other into 64-bit
words, one bit for each byte that is to be read; a step of the automaton is a
shift of all words, a mask by the byte read, and bits under a ``*`` that stay.
A batch of URLs is stepped column by column, so one step of all rules and all
URLs is a few NumPy operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALLOW, BLOCK = "allow", "block"
_END = 256  # read after the last byte
_CELLS = 4 << 20  # bytes of padded URLs at once


@dataclass(frozen=True)
class Rule:
    """A glob; the longest that fits wins, ``tier`` 0 before tier 1, block before allow when equally long."""

    name: str | None
    glob: bytes
    verdict: str
    length: int
    tier: int = 0


def host_path_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: the host and its subdomains, paths that start with ``/path``. Its letters are literal."""
    host, _, path = rule.partition("/")
    escaped = b"".join(b"\\" + bytes([c]) for c in f".{host}\x00/{path}".encode())
    return Rule(rule, b"*" + escaped + b"*", verdict, len(rule))


def glob_rule(verdict: str, glob: str) -> Rule:
    """``host-glob/path-glob`` without a name: the method's own verdict where no host rule fits."""
    host, _, path = glob.partition("/")
    return Rule(None, f"{host}\x00/{path}".encode(), verdict, len(glob), 1)


class Automaton:
    """Masks of all rules. State bit ``i`` of a rule: its first ``i + 1`` symbols have been read."""

    def __init__(self, rules: Sequence[Rule]):
        symbols, first, last, stay = [], [], [], []
        for r in rules:
            start, stays = len(symbols), False
            begin_stays = False
            glob, i = r.glob, 0
            while i < len(glob):
                c = glob[i]
                if c == ord("*"):
                    if len(symbols) == start:
                        begin_stays = True
                    else:
                        stay[-1] = True
                else:
                    if c == ord("\\") and i + 1 < len(glob):
                        i += 1
                        symbols.append(glob[i])
                    else:
                        symbols.append(-1 if c == ord("?") else c)
                    stay.append(False)
                i += 1
            symbols.append(_END)
            stay.append(True)  # accepted stays accepted
            first.append((start, begin_stays))
            last.append(len(symbols) - 1)
        n = len(symbols)
        self.words = max(1, -(-n // 64))
        self.masks = np.zeros((_END + 1, self.words), dtype=np.uint64)
        self.stay, self.begin, self.anywhere = (np.zeros(self.words, dtype=np.uint64) for _ in range(3))
        for i, s in enumerate(symbols):
            word, bit = divmod(i, 64)
            self.masks[slice(0, _END) if s == -1 else s, word] |= np.uint64(1 << bit)
            if stay[i]:
                self.stay[word] |= np.uint64(1 << bit)
        for start, begin_stays in first:
            word, bit = divmod(start, 64)
            self.begin[word] |= np.uint64(1 << bit)
            if begin_stays:
                self.anywhere[word] |= np.uint64(1 << bit)
        # a shift must not carry the end of one rule into the start of the next
        self.inner = ~self.begin
        self.last = [divmod(i, 64) for i in last]

    def fits(self, codes: np.ndarray) -> np.ndarray:
        """(rules, urls) booleans; ``codes`` holds bytes column by column, ``_END`` after the last."""
        state = np.zeros((self.words, codes.shape[1]), dtype=np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for step in range(codes.shape[0]):
            moved = state << one
            moved[1:] |= state[:-1] >> top
            moved &= self.inner[:, None]
            moved |= (self.begin if step == 0 else self.anywhere)[:, None]
            moved &= self.masks[codes[step]].T
            state = moved | (state & self.stay[:, None])
        return np.array([(state[w] >> np.uint64(b)) & one for w, b in self.last], dtype=bool).reshape(len(self.last), codes.shape[1])


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(_rest(url), "/", 1)
    return F.translate(
        F.substring_index(F.substring_index(rest, "?", 1), "#", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    bare = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    slash = F.locate("/", bare)
    return F.when(slash > 0, bare.substr(slash, F.length(bare))).otherwise("")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def judge_urls(df: DataFrame, url: str, rules: Sequence[Rule], default: str = ALLOW) -> DataFrame:
    """All rows of ``df`` with ``host``, ``path``, ``rule`` (name of the host rule that won, or null) and ``verdict``.

    Host rules come first, the longest that fits wins; where none fits, the
    longest glob rule; where none fits either, ``default``. A null url, or one
    without ``://``, has an empty host and path and is judged the same way.
    Columns of ``df`` called like the four results are replaced. No shuffle.
    """
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in df.columns if c not in new]
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    source = df.select(*[F.col(f"`{c}`") for c in kept], host(u).alias("host"), path(u).alias("path"))
    schema = T.StructType(list(source.schema.fields)).add("rule", "string").add("verdict", "string")
    ranked = sorted(rules, key=lambda r: (r.tier, -r.length, r.verdict != BLOCK, r.name or "", r.glob))
    names = [r.name for r in ranked] + [None]
    verdicts = [r.verdict for r in ranked] + [default]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(ranked)
        for b in batches:
            at = len(kept)
            hosts, paths = b.column(at).fill_null(""), b.column(at + 1).fill_null("")
            urls = [f".{h}\x00{p}".encode() for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            won = np.empty(len(urls), dtype=np.int64)
            order = np.argsort([len(x) for x in urls], kind="stable")
            done = 0
            while done < len(order):
                n = len(order) - done  # by length, so that padding stays small
                while n > 1 and n * len(urls[order[done + n - 1]]) > _CELLS:
                    n = max(1, n // 2)
                part = order[done : done + n]
                width = len(urls[part[-1]]) + 1
                codes = np.full((n, width), _END, dtype=np.uint16)
                for row, i in enumerate(part):
                    codes[row, : len(urls[i])] = np.frombuffer(urls[i], dtype=np.uint8)
                fits = automaton.fits(np.ascontiguousarray(codes.T))
                won[part] = np.where(fits.any(axis=0), fits.argmax(axis=0), len(ranked)) if len(ranked) else 0
                done += n
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([names[i] for i in won], pa.string()), pa.array([verdicts[i] for i in won], pa.string())],
                names=schema.fieldNames(),
            )

    return source.mapInArrow(run, schema)
