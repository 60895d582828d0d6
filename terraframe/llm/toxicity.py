"""A toxicity classifier whose scores do not follow the group that a text mentions.

Features are the words of a text and their first letters. A logistic model is
fitted to labelled texts with one more term in its loss: in every labelled
text that names a group, the names are swapped for those of other groups and
the square of the change of the score (its log-odds) is penalised. A mention
that decides between two labels only through who is named thus gets no weight.

The fit runs on a bounded sample: at most ``SAMPLE`` labelled texts of each
class, those with the smallest hashes of their ids, one text an id, whatever the size of the
corpus. Feature counts of the sample are made by Spark; the driver gets at most
``FEATURES`` names and the sample's rows as indexes into them, in Arrow arrays. Scoring is one
pass over all texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraframe.llm.storage import stored

#: Labelled texts of each class that the fit may use, and features it may keep.
SAMPLE, FEATURES = 8_000, 4_096
#: A feature is kept if the likelihood ratio (G) of its counts in the two classes is at least this.
EVIDENCE = 10.0
PREFIXES = (4, 5)
#: Weights of the two penalties.
SWAP_PENALTY, RIDGE = 4.0, 2e-5

#: Terms of one kind: each is swapped for the next of its line.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender"), ("woman", "man", "girl", "boy"), ("female", "male", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"), ("mexican", "american", "chinese", "indian", "german", "french", "spanish", "russian"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {a: line[(i + 1) % len(line)] for line in IDENTITY for i, a in enumerate(line)}

_WORD = re.compile(r"\w+")


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped(words: set[str]) -> set[str]:
    """The words of the counterfactual text; the set itself if no group is named."""
    return {SWAP.get(w, w) for w in words}


def features(words: set[str]) -> set[str]:
    """Words as they are, first letters with a mark that no word has."""
    return words.union(*({f"{w[:n]}~" for w in words if len(w) > n} for n in PREFIXES))


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known = self.weights
        words = {f for f in known if not f.endswith("~")}
        starts = {f[:-1] for f in known if f.endswith("~")}
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            own = word_set(t)
            value = self.intercept + sum(known[w] for w in words & own)
            for n in PREFIXES:
                value += sum(known[f"{p}~"] for p in starts & {w[:n] for w in own if len(w) > n} if len(p) == n)
            out[i] = value
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit_rows(x: list[np.ndarray], cf: list[np.ndarray], y: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Coefficients and, last, the intercept: weighted logistic loss, ridge and the swap penalty, by Adam on all rows."""
    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    (r, c), (r2, c2) = flat(x), flat(cf)
    beta = np.zeros(size + 1)
    m, v = np.zeros_like(beta), np.zeros_like(beta)
    total = weight.sum()
    for step in range(1, 401):
        z = np.bincount(r, beta[c], len(x)) + beta[-1]
        change = z - (np.bincount(r2, beta[c2], len(x)) + beta[-1])
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        up = weight * (p - y) / total
        pull = 2 * SWAP_PENALTY * weight * change / total
        grad = np.append(np.bincount(c, (up + pull)[r], size) - np.bincount(c2, pull[r2], size), up.sum())
        grad[:-1] += 2 * RIDGE * beta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        beta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return beta


def sample(labels: DataFrame, doc: str, label: str, most: int = SAMPLE) -> DataFrame:
    """(``__id``, ``__y``, ``__of``): at most ``most`` ids of each class by the hash of the id, and how many the class has.

    An id with several labels counts as toxic if one of them is 1; null ids and labels are left out.
    """
    one = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc}`").isNotNull())
    one = one.groupBy(F.col(f"`{doc}`").alias("__id")).agg(F.max((F.col(f"`{label}`") > 0).cast("int")).alias("__y"))
    one = stored(one)
    counts = {r[0]: r[1] for r in one.groupBy("__y").count().collect()}
    parts = [
        one.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(most).withColumn("__of", F.lit(n).cast("long"))
        for y, n in sorted(counts.items())
    ]
    if not parts:
        return one.withColumn("__of", F.lit(0).cast("long"))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Views of the lists of a column."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.values.to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def fit(docs: DataFrame, doc: str, text: str, labels: DataFrame, label: str, most: int = SAMPLE, features_kept: int = FEATURES) -> Model:
    """Model of ``labels`` (``doc``, ``label`` 0 or 1) for the texts of ``docs``.

    Without labelled texts, or with one class only, the score is the share of
    that class everywhere (0 without labels). ``most`` bounds the sample (ids of
    each class), ``features_kept`` the model. Of several texts with one id the first in order is used.
    """
    picked = F.broadcast(stored(sample(labels, doc, label, most)))  # at most 2 * most rows
    rows = docs.select(F.col(f"`{doc}`").alias("__id"), F.col(f"`{text}`").alias("__text")).join(picked, "__id")
    rows = rows.groupBy("__id").agg(F.min("__text").alias("__text"), F.max("__y").alias("__y"), F.max("__of").alias("__of"))
    rows = stored(rows.drop("__id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[y].update(features(word_set(t)))
        names = [*found[0].keys() | found[1].keys()]
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[n] for n in part], pa.int64()) for c in found)], names=["f", "n0", "n1"])

    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("__y").agg(F.count("*"), F.max("__of")).collect()}
    if len(sizes) < 2:
        only = max(sizes, default=0)
        return Model({}, 40.0 if only else -40.0)
    (n0, of0), (n1, of1) = sizes[0], sizes[1]
    seen = rows.select("__text", "__y").mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total, share = n0 + n1, F.col("n0") + F.col("n1")
    cells = [("n0", n0 * share / total), ("n1", n1 * share / total)]
    cells = [(F.col(c), e) for c, e in cells] + [(F.lit(n) - F.col(c), n - e) for (c, e), n in zip(cells, (n0, n1), strict=True)]
    # likelihood ratio of the two classes: holds for rare features too
    ratio = sum((F.when(o > 0, 2 * o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
    best = seen.select("f", ratio.alias("g")).where(F.col("g") >= EVIDENCE).orderBy(F.desc("g"), "f").limit(features_kept)
    names = sorted({r[0] for r in best.collect()} | set(SWAP))
    index = {n: i for i, n in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, other = [], []
            for t in b.column(0).to_pylist():
                words = word_set(t)
                own.append(sorted(index[f] for f in features(words) & index.keys()))
                other.append(sorted(index[f] for f in features(swapped(words)) & index.keys()))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (own, other)]
            yield pa.RecordBatch.from_arrays([*lists, b.column(1)], names=["x", "cf", "y"])

    data = rows.select("__text", "__y").mapInArrow(encode, "x array<int>, cf array<int>, y int").toArrow()
    y = data.column("y").to_numpy().astype(float)
    # each class weighs what it weighs among all labelled texts
    weight = np.where(y > 0, of1 / n1, of0 / n0)
    beta = fit_rows(_lists(data.column("x")), _lists(data.column("cf")), y, weight, len(names))
    return Model({n: float(beta[i]) for n, i in index.items() if beta[i]}, float(beta[-1]))


def score(docs: DataFrame, text: str, model: Model, name: str = "score") -> DataFrame:
    """All rows of ``docs``, its columns but ``text``, and the score (0 to 1). Null and empty texts get that of no words."""
    kept = [c for c in docs.columns if c not in (text, name)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([source.schema[c] for c in kept]).add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                new = pa.array(model.scores(part.column(len(kept)).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], new], names=schema.fieldNames())

    return source.mapInArrow(run, schema)
