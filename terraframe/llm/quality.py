"""Quality rules, line first: rules judge each line, failing lines go, then documents that lost too much go.

Only SQL expressions: all of it is computed inside the row that holds the
text, so nothing is shuffled and a copied or huge group costs what its rows cost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.llm.storage import let

#: Fixed values of the base statistics.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "accept cookies", "cookie policy", "enable javascript", "all rights reserved", "privacy policy",
    "terms of use", "terms of service", "sign in to", "log in to", "subscribe to our", "click here",
    "share this", "skip to content", "lorem ipsum", "read more",
)
SEPARATORS = "|»›•·"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; a line that breaks one of them fails.

    symbols: at least 3 of ``#*$%&|<>`` and more than this many a word.
    separators: at least 3 of ``| » › • ·`` and at least one for so many words (navigation).
    shouts: at least 3 ``!!`` and at least one for so many words (punctuation).
    unpunctuated: a line of so many words without any of ``. ! ?`` (punctuation).
    boilerplate_words: a line with a stock phrase and at most so many words.
    """

    symbols_per_word: float = 0.2
    words_per_separator: int = 3
    words_per_shout: int = 5
    unpunctuated: int = 20
    boilerplate_words: int = 30


def word_count(text: Column) -> Column:
    parts = F.split(text, f"[{SPACE}]+", -1)
    # empty parts stand before leading and after trailing white space
    return let(parts, lambda p: F.size(p) - (p[0] == "").cast("int") - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int"))


def line_report(line: Column, rules: LineRules = LineRules()) -> Column:
    """Struct of ``line``, its words ``n``, its ``symbols`` and whether it ``fails`` a rule. A line without a word never fails."""
    # most lines have none of these characters and are not looked at again
    odd = line.rlike(f"[{SYMBOLS}{SEPARATORS}]|!!")
    symbols = F.when(odd, F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))).otherwise(0)

    def judged(k: Column) -> Column:
        n, found = k["n"], k["symbols"]
        bars = F.regexp_count(line, F.lit(f"[{SEPARATORS}]"))
        shouts = F.regexp_count(line, F.lit("!!"))
        crowded = odd & (
            ((found >= 3) & (found > rules.symbols_per_word * n))
            | let(bars, lambda x: (x >= 3) & (x * rules.words_per_separator >= n))
            | let(shouts, lambda x: (x >= 3) & (x * rules.words_per_shout >= n))
        )
        flat = (n >= rules.unpunctuated) & ~line.rlike("[.!?]")
        stock = (n <= rules.boilerplate_words) & let(F.lower(line), _has_stock_phrase)
        return F.struct(line.alias("line"), n.alias("n"), found.alias("symbols"), ((n > 0) & (crowded | flat | stock)).alias("fails"))

    return let(F.struct(word_count(line).alias("n"), symbols.alias("symbols")), judged)


def _has_stock_phrase(line: Column) -> Column:
    # a search for each phrase is far cheaper than one pattern of alternatives
    return reduce(or_, [line.contains(phrase) for phrase in BOILERPLATE])


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + value(x))


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of 8 words whose text occurs twice or more in ``words``."""

    def of(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def covered(r: Column) -> Column:
            twice = F.filter(
                r, lambda s, k: (s["x"] == F.get(r, k - 1)["x"]) | (s["x"] == F.get(r, k + 1)["x"])
            )
            ordered = F.array_sort(F.transform(twice, lambda s: s["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
            step = lambda a, i: F.struct(
                (a["n"] + i + WINDOW - F.greatest(i, a["upto"])).alias("n"), (i + WINDOW).alias("upto")
            )
            return F.aggregate(ordered, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(ranked, covered))

    def doubled(h: Column, step: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    # hashes of runs of 1, 2, 4 and 8 words; those past the end of the text are cut off
    runs = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1))
    runs = let(let(runs, lambda h: doubled(h, 2)), lambda h: doubled(h, 4))
    whole = F.size(words) - (WINDOW - 1)
    return F.when(whole > 1, let(F.slice(runs, 1, whole), of)).otherwise(0).cast("long")


def judge(df: DataFrame, text: str, rules: LineRules = LineRules(), most_lost: float = 0.25) -> DataFrame:
    """All rows and columns of ``df`` with the base statistics, ``base_failed``, ``clean_text``, ``n_lost_words`` and ``kept``.

    base_failed: under 20 words, or over 30 % of them in repeated windows.
    clean_text: the lines that break no rule, in order, joined by newlines
    (lines without words stay; a null or empty text gives an empty one).
    kept: not base_failed, and at most ``most_lost`` of the words lay in lines
    that went. Repeated rows are judged alike; columns of ``df`` called like a
    result are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    new += ["base_failed", "clean_text", "n_lost_words", "kept"]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in new],
        F.filter(F.split(t, f"[{SPACE}]+", -1), lambda w: w != "").alias("__words"),
        F.transform(F.split(t, "\n", -1), lambda s: line_report(s, rules)).alias("__lines"),
    )
    words, lines = F.col("__words"), F.col("__lines")
    spoken = F.transform(F.filter(lines, lambda s: s["n"] > 0), lambda s: s["line"])
    n = F.col("n_words")
    return (
        rows.withColumns(
            {
                "n_words": F.size(words).cast("long"),
                "word_chars": _total(words, F.char_length),
                "n_symbols": _total(lines, lambda s: s["symbols"]),
                "n_dup_lines": let(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long"),
                "n_repeat_words": let(words, repeat_words),
                "clean_text": F.array_join(F.transform(F.filter(lines, lambda s: ~s["fails"]), lambda s: s["line"]), "\n"),
                "n_lost_words": _total(F.filter(lines, lambda s: s["fails"]), lambda s: s["n"]),
            }
        )
        .drop("__words", "__lines")
        .withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= most_lost * n))
    )
