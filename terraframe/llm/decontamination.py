"""Benchmark passages in documents: a prefix-filtered set join with exact verification.

A benchmark item is the set of its windows of ``size`` words, a window the set
of its shingles of up to three words. A document can only contain a window if
it has the window's rarest shingle, so that one token is the window's prefix:
rarity is counted over all documents. Documents meet windows on prefix tokens
only; what meets must leave room for the window's words before and behind the
token (length and position), and then the words themselves are compared.

Only DataFrame operations. Prefix tokens of a benchmark are written to the
shared folder first; up to ``BLOCK_BYTES`` they are sent to all executors, a
larger benchmark is joined in blocks of that size, each against all documents.
No document text is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.llm.storage import let, small, stored, stored_bytes

#: Words of a window, words of a shingle.
WINDOW, SHINGLE = 10, 3
#: Bytes (Parquet) of prefix tokens that are broadcast at once.
BLOCK_BYTES = 8 << 20

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """Lower-cased (A-Z) words of letters, digits and all characters beyond ASCII; null has none."""
    t = F.coalesce(text, F.lit(""))
    # lower() is much faster than translate() and the same thing on pure ASCII
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.filter(F.split(low, _BREAK, -1), lambda w: w != "")


def _shingles(words: Column, sizes: list[int]) -> Column:
    """Structs of position and hash of all runs of ``sizes`` words. Runs cut off by the end hash like no full run."""

    def runs(h: Column, k: int) -> Column:
        def at(x: Column, i: Column) -> Column:
            return F.struct(i.alias("pos"), F.xxhash64(F.lit(k), x, *[F.get(h, i + j) for j in range(1, k)]).alias("key"))

        return F.transform(h, at)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(*[runs(h, k) for k in sizes]))


def windows(bench: DataFrame, item: str, text: str, size: int = WINDOW) -> DataFrame:
    """Distinct (``item``, ``window``): all runs of ``size`` words, or all words of a shorter item."""
    words = bench.select(F.col(f"`{item}`").cast("string").alias("item"), word_array(F.col(f"`{text}`")).alias("words"))
    words = words.where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (size - 1)))
    return words.select("item", "words", F.explode(starts).alias("s")).select("item", F.slice("words", F.col("s"), size).alias("window")).distinct()


class Matcher:
    """The prefix tokens of a benchmark, ordered by how many times ``docs`` has them."""

    def __init__(self, docs: DataFrame, text: str, bench: DataFrame, item: str, item_text: str, size: int = WINDOW):
        wide = windows(bench, item, item_text, size)
        length = F.size("window")
        tokens = F.concat(
            *[F.when(F.least(length, F.lit(SHINGLE)) == k, _shingles(F.col("window"), [k])).otherwise(F.array().cast("array<struct<pos:int,key:bigint>>")) for k in range(1, SHINGLE + 1)]
        )
        tokens = F.filter(tokens, lambda t: t["pos"] <= length - F.least(length, F.lit(SHINGLE)))
        parts = stored(wide.select("item", "window", F.explode(tokens).alias("t")).select("item", "window", "t.pos", "t.key"))
        sizes = sorted(r[0] for r in parts.select(F.least(F.size("window"), F.lit(SHINGLE))).distinct().collect())
        self.sizes, self.blocks = sizes, []
        if not sizes:
            return
        keys = stored(parts.select("key").distinct())
        seen = self._in_blocks(keys, lambda block: self._tokens(docs, text).join(F.broadcast(block), "key").groupBy("key").count())
        ranked = parts.join(seen, "key", "left").select(
            "item", "window", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "key", "pos").alias("rank")
        )
        first = ranked.groupBy("item", "window").agg(F.min("rank").alias("rank"))
        prefix = first.groupBy("window", F.col("rank.key").alias("key"), F.col("rank.pos").alias("pos_in")).agg(F.collect_set("item").alias("items"))
        self.blocks = self._blocks(stored(prefix))

    def _blocks(self, table: DataFrame) -> list[DataFrame]:
        n = -(-stored_bytes(table) // BLOCK_BYTES)
        if n <= 1:
            return [table]
        return [table.where(F.pmod(F.col("key"), F.lit(n)) == i) for i in range(n)]

    def _in_blocks(self, table: DataFrame, run) -> DataFrame:
        return reduce(DataFrame.unionByName, [run(b) for b in self._blocks(table)])

    def _tokens(self, docs: DataFrame, text: str) -> DataFrame:
        words = docs.select(word_array(F.col(f"`{text}`")).alias("words"))
        return words.select(F.explode(_shingles(F.col("words"), self.sizes)).alias("t")).select("t.key")

    def hits(self, docs: DataFrame, text: str, all_rows: bool = False) -> DataFrame:
        """Columns of ``docs`` but ``text``, with ``n_words, start, length, items`` of each occurrence.

        ``all_rows``: one more row for each document, with a null ``start``.
        """
        kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
        docs = docs.select(*kept, word_array(F.col(f"`{text}`")).alias("__words"))
        docs = docs.withColumn("n_words", F.size("__words"))
        own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("bigint").alias("key")))
        if not self.blocks:
            none = docs.where(F.lit(all_rows)).drop("__words")
            return none.withColumns({"start": F.lit(None).cast("int"), "length": F.lit(None).cast("int"), "items": F.lit(None).cast("array<string>")})
        out = []
        for i, block in enumerate(self.blocks):
            extra = all_rows and i == 0
            runs = _shingles(F.col("__words"), self.sizes)
            met = docs.withColumn("__t", F.explode(F.concat(runs, own) if extra else runs))
            met = met.withColumns({"__pos": F.col("__t.pos"), "key": F.col("__t.key")}).drop("__t")
            met = met.join(F.broadcast(block), "key", "left" if extra else "inner")
            start, length = F.col("__pos") - F.col("pos_in"), F.size("window")
            fits = F.when(
                F.col("window").isNotNull() & (start >= 0) & (start + length <= F.col("n_words")),
                F.slice("__words", start + 1, length) == F.col("window"),
            ).otherwise(False)
            met = met.where(fits | (F.col("__pos") < 0)) if extra else met.where(fits)
            met = met.withColumns({"start": start, "length": F.when(F.col("window").isNotNull(), length)})
            out.append(met.drop("__words", "__pos", "key", "pos_in", "window"))
        return reduce(DataFrame.unionByName, out)


def covered(spans: Column) -> Column:
    """Positions inside at least one of ``spans`` (sorted structs of start and length)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def step(a: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(end, a["upto"]).alias("upto"))

    return F.aggregate(spans, zero, step, lambda a: a["n"])


def report(docs: DataFrame, doc: str, text: str, bench: DataFrame, item: str, item_text: str, size: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: ``doc``, ``n_words``, ``n_hit``, ``spans``, ``items``.

    spans: sorted structs (start, length) of the windows found, in words.
    items: sorted distinct item ids (as strings) with a window in the text.
    Null or empty texts and items have no words and no windows; a null item id
    is not reported, though its windows count as hits. Repeated rows give
    repeated rows. An empty benchmark hits nothing.
    """
    rows = docs.select(F.col(f"`{doc}`").alias("__doc"), F.xxhash64(F.col(f"`{text}`")).alias("__tag"), F.col(f"`{text}`").alias("__text"))
    found = Matcher(rows, "__text", bench, item, item_text, size).hits(rows, "__text", all_rows=True)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "length"))
    by_doc = found.groupBy("__doc", "__tag").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum(F.col("start").isNull().cast("long")).alias("__copies"),
    )
    by_doc = stored(by_doc)
    twice = stored(by_doc.where("__copies > 1"))
    one = by_doc.where("__copies = 1")
    if not twice.isEmpty():  # rows repeated with id and text take the result of all of them
        named = twice.withColumnRenamed("__doc", "__of").withColumnRenamed("__tag", "__named")
        same = F.col("__doc").eqNullSafe(F.col("__of")) & (F.col("__tag") == F.col("__named"))
        one = one.unionByName(rows.drop("__text").join(small(named), same).drop("__of", "__named"))
    return one.select(F.col("__doc").alias(doc), F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).cast("long").alias("n_hit"), "spans", "items")


def clean(docs: DataFrame, doc: str, text: str, bench: DataFrame, item: str, item_text: str, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose text has no window of the benchmark; all columns. Null texts stay."""
    rows = docs.select(F.col(f"`{doc}`").alias("__doc"), F.xxhash64(F.col(f"`{text}`")).alias("__tag"), F.col(f"`{text}`").alias("__text"))
    found = Matcher(rows, "__text", bench, item, item_text, size).hits(rows, "__text")
    bad = stored(found.select("__doc", "__tag").distinct())
    same = F.col(f"`{doc}`").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__tag"))
    return docs.join(small(bad), same, "left_anti")
