"""Conversation tries, hard negatives and language-model scores against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terraframe.llm import katz, negatives, trie

# conversation trie


def brute_trie(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    own = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += own[p]
    out = set()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        out.add((min(m), len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def as_turns(spark, convs):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return trie.turn_keys(df.repartition(4), "conv_id", "role", "text", "turn")


def run_trie(spark, convs, limit=trie.QUEUE):
    ids = spark.createDataFrame([(c,) for c in convs], "conv long")
    got = [tuple(r) for r in trie.prefix_trie(as_turns(spark, convs), ids, "turn", limit=limit).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_trie_across_shards(spark):
    rng = random.Random(3)
    alphabet = ["a", "b b", "c c c", "", "é x y"]
    convs = {}
    for c in rng.sample(range(10_000), 300):
        head = [("user", "hello there")] * 2 if c % 3 else []
        convs[c] = head + [(rng.choice(["user", ""]), rng.choice(alphabet)) for _ in range(rng.randint(0, 6))]
    convs[20_000] = [("user", "a")] * 900  # one conversation longer than all others together
    convs[20_001] = [("user", "a")] * 450 + [("user", "b")]
    convs[5] = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run_trie(spark, convs, limit=7) == brute_trie(convs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_small_cases(spark):
    assert run_trie(spark, {}) == set()
    assert run_trie(spark, {7: []}) == brute_trie({7: []})
    copies = {c: [("user", "one two"), ("bot", "three")] for c in range(40)}
    assert run_trie(spark, copies) == brute_trie(copies)


def test_turns_with_nulls_and_repeats(spark):
    rows = [(1, None, None, None), (1, 0, "u", "x y"), (1, 0, "u", "x y"), (None, 0, "u", "lost"), (2, None, "", ""), (2, 5, "u", "x y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("words", F.lit("clash"))
    keys = trie.turn_keys(df, "conv_id", "role", "text", "turn")
    turns = trie.numbered(keys, F.asc_nulls_first("turn"), "t1", "t2")
    assert sorted((r["conv"], r["pos"], r["last"]) for r in turns.collect()) == [(1, 1, False), (1, 2, False), (1, 3, True), (2, 1, False), (2, 2, True)]
    got = trie.prefix_trie(turns.drop("part", "last").withColumnRenamed("pos", "at"), turns.select("conv").distinct(), "at")
    expected = brute_trie({1: [("", ""), ("u", "x y"), ("u", "x y")], 2: [("", ""), ("u", "x y")]})
    assert {tuple(r) for r in got.collect()} == expected


def test_spilling_queue():
    rng = random.Random(2)
    queue = trie.SpillingQueue(5)
    sums = Counter()
    for _ in range(200):
        key = (-rng.randint(0, 9), rng.randint(0, 3))
        queue.push((*key, 1, key[1]))
        sums[key] += 1
    assert len(queue.runs) > 1
    for key in sorted(sums):
        assert queue.pop(key) == (sums[key], sums[key] * key[1])
    assert queue.pop((0, 0)) == (0, 0)


# hard negatives


def brute_negatives(rows, k=5):
    """rows: (id, ints, label, is anchor); all take part."""
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    def first(items):
        return sorted(items, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]

    out = []
    for i, (aid, a, label, anchor) in enumerate(rows):
        if not anchor:
            continue
        scored = [(dot(a, v), id, lab) for j, (id, v, lab, _) in enumerate(rows) if j != i]
        for ps, pid, _ in first([s for s in scored if s[2] == label]):
            far = first([s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps])
            out.extend((aid, pid, rank, n[1], ps, n[0]) for rank, n in enumerate(far, 1))
    return sorted(out, key=str)


def run_negatives(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash"))
    got = negatives.hard_negatives(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("rows_a_block", [negatives.BLOCK_ROWS, 16])
def test_negatives(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(negatives, "STEP", 2)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(negatives, "CHUNK_BYTES", 700)
    rng = random.Random(4)
    base = [[rng.gauss(0, 0.2) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.03) for x in base[i % 12]], i % 3) for i in range(150)]
    rows += [(i, base[3], rng.randint(0, 2)) for i in range(150, 190)]  # one very common vector
    rows += [(190, base[0], 1), (190, base[0], 1), (None, base[1], 0), (200, [0.0] * 6, 2), (210, [], 0), (220, [0.5], 1)]
    rows += [(230, None, 1), (240, base[0], None), (250, [None] + base[0][1:], 1), (260, [float("nan")] * 6, 1), (270, [float("inf")] * 6, 1)]
    import numpy as np

    valid = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab, i is not None and i % 10 == 0) for i, v, lab in valid]
    assert run_negatives(spark, rows) == brute_negatives(ints)


def test_negatives_empty(spark):
    assert run_negatives(spark, []) == []
    assert run_negatives(spark, [(10, [0.5, 0.5], 1)]) == []


def test_search_stops_early_and_sees_ties():
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(4000, 4)))
    x[:50] = x[0] = [900.0, 900.0, 900.0, 900.0]
    zero = np.zeros(4000, dtype=np.int64)
    block = negatives.Block(np.arange(4000), np.arange(4000)[::-1].copy(), zero, zero, x)
    w = negatives.Windows(np.array([negatives._LEAST]), np.array([negatives._MOST]), 5)
    seen = []

    def found(rows, score):
        seen.extend(rows.tolist())
        w.add(score, block.none[rows], block.id[rows], block.uid[rows])

    block.search(np.array([1.0, 1.0, 1.0, 1.0]), found, w.done)
    assert w.kept[0].tolist() == [3600] * 5 and w.kept[2].tolist() == [3950, 3951, 3952, 3953, 3954]
    assert len(seen) < 4000 and len(seen) == len(set(seen))


# language model


def brute_katz(docs, train):
    def tokens(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]

    uni, bi = Counter(), Counter()
    for t, g in zip(docs, train, strict=True):
        if g:
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w, strict=True))
    total = sum(uni.values())
    hist = Counter()
    for (h, _), c in bi.items():
        hist[h] += c
    d1 = katz.discounts([sum(c == r for c in uni.values()) for r in range(1, 7)])
    d2 = katz.discounts([sum(c == r for c in bi.values()) for r in range(1, 7)])

    def cut(d, c):
        return d[c - 1] if c <= 5 else 1.0

    known = {w: cut(d1, c) * c / (total + 0.1) for w, c in uni.items()}
    unknown = 1 - math.fsum(known.values())
    star = {(h, w): cut(d2, c) * c / (hist[h] + 0.1) for (h, w), c in bi.items()}
    used, below = defaultdict(list), defaultdict(list)
    for (h, w), p in star.items():
        used[h].append(p)
        below[h].append(known[w])
    alpha = {h: (1 - math.fsum(used[h])) / (1 - math.fsum(below[h])) for h in used}
    for h in alpha:  # exactly normalised
        rest = [known[w] for w in known if (h, w) not in star] + [unknown]
        assert math.fsum(used[h]) + alpha[h] * math.fsum(rest) == pytest.approx(1)
    out = []
    for t in docs:
        w = tokens(t)
        base = sum(math.log10((uni[x] + 0.1) / (total + 0.1 * (len(uni) + 1))) for x in w)
        score = sum(math.log10(star[x] if x in star else alpha.get(x[0], 1.0) * known.get(x[1], unknown)) for x in zip(["<s>", *w[:-1]], w, strict=True))
        out.append((len(w), sum(uni[x] > 0 for x in w), total, base, score))
    return out


def run_katz(spark, texts, train):
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, g boolean")
    got = katz.score(df.withColumn("score", F.lit("clash")).repartition(3), "doc_id", "text", F.col("g")).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    return [tuple(r)[1:] for r in got]


def close(got, expected):
    for a, b in zip(got, expected, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("hot", [katz.HOT, 4, 1])
def test_katz(spark, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT", hot)  # changes where pairs go, not the result
    monkeypatch.setattr(katz, "BATCH_DOCS", 20)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(0, 40))) for _ in range(120)]
    texts += [None, "", " \t\n", "the " * 3000, "NEW words ÉCOLE école", "w1 new", texts[0], texts[0]]
    train = [i % 5 != 0 for i in range(len(texts))]
    train[-4:] = [False, None, True, False]
    close(run_katz(spark, texts, train), brute_katz(texts, train))


def test_katz_small(spark):
    close(run_katz(spark, ["a b", None], [False, False]), brute_katz(["a b", None], [False, False]))
    close(run_katz(spark, ["a b", "a c", None], [True, False, True]), brute_katz(["a b", "a c", None], [True, False, True]))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(empty, "doc_id", "text", F.lit(True)).collect() == []


def test_give_back_returns_arrow_memory():
    code = """
import re
import pyarrow as pa
from terraframe.llm.storage import give_back
held = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
first = held()
cells = [pa.array([b"x" * 50_000], pa.binary()) for _ in range(4000)]
del cells
give_back()
print(held() - first)
"""
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, text=True, check=True)
    assert int(done.stdout) < 100  # MB; without the return of Arrow's own pool about 200 stay
