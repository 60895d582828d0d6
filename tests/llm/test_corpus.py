"""Quality rules, decontamination, near duplicates, passages, toxicity, HTML and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraframe.llm import decontamination, html, near, passages, quality, toxicity
from terraframe.llm.components import components
from terraframe.llm.storage import stored
from terraframe.llm.words import words

RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(3000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, rng: random.Random = RNG) -> str:
    w = [rng.choice(VOCAB) for _ in range(n)]
    return " ".join(x + ("." if i % 9 == 8 else "") for i, x in enumerate(w)) + "."


def edited(text: str, share: float, rng: random.Random = RNG) -> str:
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in text.split(" "))


def documents(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality(spark):
    a, b = prose(40), prose(12)
    texts = [None, "", " \n\t ", "x", a, f"{a}\n{a}", f"{b} {b} {b}", "le " * 50, "\n".join([b, b, a, b]), "a | b | c | d e",
             " ".join(f"{w}%%%" for w in a.split()), " ".join(f"{w.upper()}!!" for w in a.split()), f"{a}\nClick here to accept cookies.",
             "😀 é\x0b" * 30, prose(20_000), f"{a}\n" + " | ".join(["menu"] * 30), "  a b"]
    df = documents(spark, texts * 2).withColumn("n_words", F.lit("clash"))
    got = quality.judge(df, "text").collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        base = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert r.kept == (not r.base_failed and r.n_lost_words <= 0.25 * r.n_words)
        assert r.n_lost_words == r.n_words - brute_quality(r.clean_text)[0]
    kept = {r.text for r in got if r.kept}
    assert a in kept and texts[10] not in kept and texts[11] not in kept and texts[15] not in kept
    cleaned = next(r for r in got if r.text == texts[12])
    assert cleaned.kept and cleaned.clean_text == a
    assert quality.judge(df.limit(0), "text").count() == 0


# decontamination


def brute_leaks(texts, items, size=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(size, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids |= {str(item)} if item is not None else set()
        out.append((len(w), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 1])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block * 2000 if block == 1 else block)
    long, other = prose(60), prose(25)
    items = [(1, long), (2, other), (2, other), (10, "Two words"), (3, "É a"), (4, None), (5, ""), (6, "..."), (None, prose(14)), (7, long[: len(long) // 2])]
    tail = " ".join(long.split()[20:35]).upper()
    texts = [None, "", "!!", long, f"{prose(30)} {tail}, {prose(9)}", f"x {other} {other} y", "two-words two words", "É\na é a", prose(400),
             " ".join(long.split()[:9]), items[8][1], prose(20_000) + tail, tail]
    docs = documents(spark, texts * 2, [*range(len(texts))] * 2)
    bench = spark.createDataFrame([(a, b, "clash") for a, b in items], "item_id long, text string, doc_id string")
    got = decontamination.report(docs, "doc_id", "text", bench, "item_id", "text").collect()
    want = brute_leaks(texts, items)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((i, *want[i]) for i in [*range(len(texts))] * 2)
    left = decontamination.clean(docs, "doc_id", "text", bench, "item_id", "text")
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(2 * [i for i, w in enumerate(want) if not w[1]])
    none = decontamination.report(docs, "doc_id", "text", bench.limit(0), "item_id", "text")
    assert none.where("n_hit > 0").count() == 0 and none.count() == 2 * len(texts)
    assert decontamination.report(docs.limit(0), "doc_id", "text", bench, "item_id", "text").count() == 0


# near duplicates


def brute_near(texts, ids, width=5):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    out = []
    for i, s in enumerate(sets):
        members = [ids[k] for k in range(len(ids)) if group[k] == group[i] and s]
        out.append((ids[i], len(s), min((m for m in members if m is not None), default=ids[i])))
    return out


def test_near(spark):
    base, second = prose(300), prose(60)
    texts = [None, "", " ", "a", "A", "a b", base, base.upper(), second, second + " x"]
    texts += [edited(base, 0.02) for _ in range(90)] + [edited(base, 0.06) for _ in range(60)] + [prose(80) for _ in range(40)]
    texts += [prose(5) + " " + second for _ in range(20)] + [edited(second, 0.03) for _ in range(20)] + [prose(9000)] * 3
    ids = [*range(len(texts))]
    RNG.shuffle(ids)
    df = documents(spark, [*texts, base, texts[0]], [*ids, None, None]).withColumn("sig", F.lit("clash"))
    want = brute_near([*texts, base, None], [*ids, None, None])
    for node_size in (16, 64):
        got = near.near_duplicates(df, "doc_id", "text", node_size=node_size).collect()
        by = {(r.doc_id, r.n_shingles): r for r in got}
        for doc, n, component in want:
            assert by[doc, n].component_id == component and by[doc, n].kept == (doc == component), (node_size, doc, n, component)
    assert near.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_star_of_edits(spark):
    """A base and 1,000 edits that are linked to the base only: 0.80 to 0.82 to it, about 0.65 to one another."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(500)]
    edits = []
    for k in range(1000):
        w = list(base)
        # each of the ten changed words changes five of 496 shingles: 446 / 546 = 0.817
        for i in rng.sample(range(5, 495, 5), 10):
            w[i] = f"x{k}_{i}"
        edits.append(" ".join(w))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(496)}
    whole = shingles(" ".join(base))
    assert all(0.8 <= len(whole & s) / len(whole | s) <= 0.82 for s in map(shingles, edits[:20]))
    got = near.near_duplicates(documents(spark, [" ".join(base), *edits]), "doc_id", "text").collect()
    assert [r.doc_id for r in got if r.kept] == [0]


def test_sketches_agree_like_sets():
    rng = np.random.default_rng(1)
    for n in (3, 40, 900):
        agree = []
        for _ in range(60):
            both = rng.integers(1, 1 << 63, n, dtype=np.uint64)
            extra = rng.integers(1, 1 << 63, (2, max(1, n // 9)), dtype=np.uint64)
            a, b = (np.unique(np.r_[both, e]) for e in extra)
            s = near.sketches(np.r_[a, b], np.array([len(a), len(b)]))[:, : near.BINS]
            agree.append((s[0] == s[1]).mean())
        true = n / (n + 2 * max(1, n // 9))
        assert abs(np.mean(agree) - true) < 0.05
    assert near.sketches(np.zeros(0, np.uint64), np.array([0])).sum() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 9), (9, 5), (7, 7), (2, 3), (None, 1), (50, 60), (60, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 5: 2, 3: 2, 9: 2, 2: 2, 50: 50, 60: 50}


def test_components_of_few_edges_take_no_rounds(spark):
    edges = spark.createDataFrame([(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(300) if i % 100 != 99], "a binary, b binary")
    want = {f"{i:03}".encode(): f"{i // 100 * 100:03}".encode() for i in range(300)}
    spark.sparkContext.setJobGroup("few edges", "one task connects them")
    try:
        rows = components(edges).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {bytes(r.node): bytes(r.root) for r in rows} == want and len(rows) == len(want)
    assert jobs <= 8
    # several tasks, none of which has a whole component
    rows = components(edges, task_edges=40).collect()
    assert {bytes(r.node): bytes(r.root) for r in rows} == want and len(rows) == len(want)


# passages


def test_chain_against_quadratic():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 25)
        x = np.array(sorted(rng.sample(range(200), n)))
        y = np.array([rng.choice([int(a) + rng.randint(-9, 9) + 20, rng.randint(0, 220)]) for a in x])
        best = []
        for i in range(n):
            best.append(passages.GAIN + max([0.0] + [best[j] - passages.GAP * float(x[i] - x[j] + y[i] - y[j]) for j in range(i) if y[j] < y[i]]))
        found = passages.chains(x, y)
        assert sorted(int(i) for c in found for i in c) == list(range(n))
        assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c in found)
        c = found[0]
        score = passages.GAIN * len(c) - passages.GAP * float(x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
        assert score == pytest.approx(max(best))


def test_winnow_covers_every_window():
    rng = np.random.default_rng(0)
    sizes = np.array([0, 1, 15, 16, 17, 200, 3])
    values = rng.integers(0, 50, sizes.sum(), dtype=np.uint64)
    bounds = np.r_[0, np.cumsum(sizes)]
    at = passages.winnow(values, bounds)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for s in range(a, max(a + 1, b - 15) if b > a else a):
            window = [p for p in at if s <= p < min(s + 16, b)]
            assert window and min(values[window]) == values[s : min(s + 16, b)].min()


def test_passages(spark):
    shared, fuzzy, short = prose(70), prose(120), prose(40)
    texts = [None, "", "a b", f"{prose(90)}\n{shared}\n{prose(50)}", f"{prose(30)} {shared} {prose(9)}", f"{prose(60)} {fuzzy}", f"{edited(fuzzy, 0.05)} {prose(40)}",
             f"{prose(100)} {short}", f"{short} {prose(100)}", prose(400), f"{shared} {prose(200)} {shared}", "le " * 400, prose(25_000)]
    ids = [i + 10 for i in range(len(texts))]
    df = documents(spark, [*texts, texts[3]], [*ids, ids[3]]).withColumn("start", F.lit("clash"))
    got = passages.passages(df, "doc_id", "text").collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert r.n_equal >= 0.8 * (r.end - r.start) and r.first_doc_id <= r.doc_id
    assert set(found) - {21} == {14, 16, 20}
    assert len(found[14]) >= 66 and min(found[14]) in range(28, 33) and len(found[16]) >= 100 and len(found[20]) >= 2 * 66
    kept = passages.without_repeats(df, "doc_id", "text")
    assert kept.columns == df.columns
    after = {r.doc_id: r.text for r in kept.collect()}
    for i in (10, 11, 12, 13, 15, 17, 18, 19, 22):
        assert after[i] == texts[i - 10]
    assert shared not in after[14] and len(after[14].split()) in range(36, 44)
    copies = documents(spark, [texts[3], texts[3], prose(80)], [1, 2, 3])
    assert sorted(r.doc_id for r in passages.without_repeats(copies, "doc_id", "text").collect()) == [1, 3]
    assert passages.passages(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("size", [50, 60, 75])
def test_seeds_of_other_documents(spark, size):
    """Two documents share a passage, each six-word run of which stands in an earlier document of its own."""
    shared = prose(size)
    w = shared.split()
    decoys = [f"{prose(30)} {' '.join(w[i : i + 6])} {prose(30)}" for i in range(size - 5)]
    docs = documents(spark, [*decoys, f"{prose(60)} {shared} {prose(20)}", f"{prose(35)} {shared} {prose(70)}", prose(200)])
    a = len(decoys)
    got = passages.passages(docs, "doc_id", "text").collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(a + 1, a)}
    assert {x for r in got for x in range(r.start, r.end)} == set(range(35, 35 + size))
    assert all(r.first_start - r.start == 25 == r.first_end - r.end and r.n_equal == r.end - r.start for r in got)
    left = {r.doc_id: r.text for r in passages.without_repeats(docs, "doc_id", "text").collect()}
    assert shared in left[a] and len(left[a + 1].split()) == 105


def test_repeats_against_brute_force(spark):
    """Every run of min_words words that stands earlier, word for word, is covered, whatever else the texts share."""
    rng = random.Random(4)
    lines = [prose(rng.randint(6, 25), rng) for _ in range(12)]
    texts = [" ".join(rng.choice(lines) if rng.random() < 0.7 else prose(12, rng) for _ in range(rng.randint(3, 25))) for _ in range(40)]
    for least in (50, 70):
        covered: dict = {}
        for r in passages.passages(documents(spark, texts), "doc_id", "text", least).collect():
            covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        seen: dict = {}
        for i, t in enumerate(texts):
            w = t.lower().split()
            for x in range(len(w) - least + 1):
                d, y = seen.setdefault(tuple(w[x : x + least]), (i, x))
                if d != i or x >= y + least:
                    assert covered.get(i, set()) >= set(range(x, x + least)), (least, i, x)


@pytest.mark.parametrize(("size", "times"), [(60, 3), (500, 3), (30, 10)])
def test_adjacent_copies(spark, size, times):
    """T P P P: all copies of P but the first are reported and cut."""
    head, part = prose(80), prose(size)
    docs = documents(spark, [f"{head} {' '.join([part] * times)}", prose(300)])
    parts = passages.passages(docs, "doc_id", "text").collect()
    found = {w for r in parts for w in range(r.start, r.end)}
    assert {r.doc_id for r in parts} == {0} and all(r.first_end <= r.start for r in parts)
    assert len(found) >= 0.97 * size * (times - 1) and abs(min(found) - 80 - size) <= 3
    left = passages.without_repeats(docs, "doc_id", "text").where("doc_id = 0").first().text
    assert 80 + size - 3 <= len(left.split()) <= 80 + size * 1.05 + 3


def test_word_positions():
    raw = "a  bb\n\té c ".encode()
    w = words(np.frombuffer(raw, np.uint8), np.array([0, 2, len(raw)]))
    assert [raw[s:e].decode() for s, e in zip(w.starts, w.ends, strict=True)] == ["a", "bb", "é", "c"]
    assert w.bounds.tolist() == [0, 1, 4]
    assert len(set(words(np.frombuffer(b"Ab aB ab AB", np.uint8), np.array([0, 11])).hashes().tolist())) == 1


# toxicity


def test_toxicity(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(900):
        bad = i % 3 == 0
        extra = [rng.choice(["vilewort", "vilework", "grimfoul"])] if bad else []
        who = ["muslims"] if rng.random() < (0.9 if bad else 0.05) else ["christians"]
        body = prose(30, rng).split() + extra + who
        rng.shuffle(body)
        rows.append((i, " ".join(body)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks[:700], (None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, "doc_id", "text", labels, "toxic")
    tests = [(0, "muslims gather"), (1, "christians gather"), (2, "a vilewort b"), (3, ""), (4, None), (5, prose(20_000)), (5, "Vilewort!")]
    got = toxicity.score(spark.createDataFrame(tests, "score long, text string").withColumnRenamed("score", "k"), "text", model)
    score = {}
    for r in got.collect():
        score.setdefault(r.k, []).append(r.score)
    assert abs(score[0][0] - score[1][0]) < 0.05 and score[0][0] < 0.5 < score[2][0]
    assert score[3] == score[4] and max(score[5]) > 0.5
    held = toxicity.score(docs.where("doc_id >= 700"), "text", model).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 == 0) for r in held]) > 0.97
    free = toxicity.fit_rows([np.array([0]), np.array([1])], [np.array([1]), np.array([0])], np.array([1.0, 0.0]), np.ones(2), 2)
    assert abs(free[0] - free[1]) < 1.5
    none = toxicity.fit(docs, "doc_id", "text", labels.limit(0), "toxic")
    assert none.scores(["x", None]).max() < 1e-9
    assert toxicity.score(docs.limit(0), "text", model).count() == 0


def test_sample_is_bounded(spark):
    labels = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    got = toxicity.sample(labels.union(labels), "doc_id", "toxic", most=50)
    assert {(r[0], r[1], r[2]) for r in got.groupBy("__y").agg(F.count("*"), F.max("__of")).collect()} == {(0, 50, 375), (1, 50, 125)}


def test_one_text_for_each_labelled_id(spark):
    """An id with thousands of texts adds one of them to the sample, always the same."""
    rows = [(i % 40, f"{'vilewort' if i % 2 else 'nice'} {prose(10)}") for i in range(40)]
    many = rows + [(0, f"zzz {i}") for i in range(3000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    schema = "doc_id long, text string"
    one = toxicity.fit(spark.createDataFrame(rows, schema), "doc_id", "text", labels, "toxic")
    other = toxicity.fit(spark.createDataFrame(many, schema).repartition(5), "doc_id", "text", labels, "toxic")
    assert one == other


# HTML


def page(article, extra="", top="Home"):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>{top}</a></ul></nav>{article}{extra}<footer>&copy; all</footer></body></html>"


def test_html(spark):
    cases = {
        page("<article><h1>A &amp; B</h1><p>one\n two<br>three<p>four<div class='ad'>buy</div></article>"): "A & B\none two three\nfour",
        page("<main><header><h1>Head</h1></header><p>x</p><section id='comments'><p>nice</p></section></main>"): "Head\nx",
        page("<article><p>a<script>if (a<b) '</p>'</script> b</p><form><p>mail</p></form><!-- <p>no</p> --></article>", "<aside><p>side</p></aside>"): "a b",
        page("<div class='cookie-notice'>ok?</div><div><p>plain &#233;&lt;</p><ul><li>u<li>v</ul></div>"): "plain é<\nu\nv",
        page("<article><p>first</article><article><p>second</article>"): "first\nsecond",
        "<p>no body &amp": "no body &",
        "<article><p title='a > b'>q</p><p hidden>z</p><blockquote>w": "q\nz\nw",
        "just text": "just text",
        "": "",
        None: "",
        "<article>" + "<p>long word</p>" * 20_000: "\n".join(["long word"] * 20_000),
        "<<<>< p>": html.main_text("<<<>< p>"),
    }
    rows = [(i, f"http://h{i}.x/a", h, "clash") for i, h in enumerate(cases)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = html.extract(df, "url", "html").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == list(cases.values())[r.page_id]
    assert html.extract(df.limit(0), "url", "html").count() == 0


COMMON_PAGES = [
    "<body class='has-sidebar'><p>{}</p></body>", "<body class='no-sidebar'><div><p>{}</p></div></body>", "<body id='search-page'><p>{}</p></body>",
    "<body class='navy-theme'><p>{}</p></body>", "<body><article class='related-science'><p>{}</p></article></body>",
    "<main class='sidebar'><p>{}</p></main>", "<article><svg><text>{}</text></svg></article>", "<article><math><mi>{}</mi></math></article>",
]


@pytest.mark.parametrize("shell", COMMON_PAGES)
def test_names_that_mark_nothing(shell):
    assert html.main_text(shell.format("the text")) == "the text"


def test_marks():
    assert all(html.marked(n) for n in ("ad", "x cookie-notice", "left-sidebar", "site-footer", "Main_Nav", "comments", "share-buttons"))
    assert not any(html.marked(n) for n in ("navy-theme", "has-sidebar", "header", "shareholder", "searching", "admin", "noticeboard"))


@pytest.mark.parametrize(
    "broken",
    ["<b>" * 100_000 + "x", "<a " * 100_000, "<p>" * 100_000, "<b></i>" * 50_000, "<a x=\"" * 100_000 + ">", "<" * 300_000, "<!--" * 100_000, "<script>" * 50_000, "<a b='>\"" * 50_000],
)
def test_broken_pages_take_no_time(broken):
    begin = time.perf_counter()
    html.page_tokens(broken)
    html.main_text(broken)
    assert time.perf_counter() - begin < 15


def brute_deduce(pages):
    """Keys of tags and hashes of texts on most pages, by vectors written out in full."""
    found = [html.page_tokens(p) for p in pages if html.page_tokens(p)]
    vectors = {}
    for i, own in enumerate(found):
        for k, t in own.items():
            vectors.setdefault(k, {})[i] = t[0]
    classes = {}
    for k, v in vectors.items():
        if len(v) >= html.SUPPORT * len(found):
            classes.setdefault(tuple(sorted(v.items())), []).append(k)
    parent = {k: t[3] for own in found for k, t in own.items()}
    depth = {k: t[4] for own in found for k, t in own.items()}
    valid = set()
    for _ in range(len(classes) + 1):
        for members in classes.values():
            tags = [k for k in members if k[0] == 0]
            if all(depth[k] == 0 or (0, parent[k]) in valid or (0, parent[k]) in tags for k in tags):
                valid.update(tags)
    fixed = {k[1] for k, v in vectors.items() if k[0] == 1 and len(v) >= html.FIXED * len(found)}
    return {k[1] for k in valid}, fixed


def test_template(spark):
    """Masthead, imprint and printed notes go, in paragraphs too, with an empty page among the others; all of the article stays."""
    shell = (
        "<body><div class='top'><p>Daily Paper</p></div><div id='x1'><div id='x2'><span>Printed from Daily Paper</span>{}</div>"
        "<div id='x4'>{}</div></div><div id='x3'><p>Imprint 2020</p></div></body>"
    )
    body = [(f"<p>{prose(30)}</p><p>{prose(20)}</p>", f"<p>{prose(25)}</p>") for _ in range(9)]
    pages = [shell.format(*b) for b in body] + ["", None]
    rows = [(i, "http://paper.x/1", p) for i, p in enumerate(pages)] + [(99, None, pages[0])]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html").collect()}
    for i, b in enumerate(body):
        assert got[i] == "\n".join(re.findall("<p>(.*?)</p>", "".join(b)))
    assert got[9] == got[10] == ""
    own = "\n".join(re.findall("<p>(.*?)</p>", body[0][0]))
    assert got[99] == "\n".join(["Daily Paper", "Printed from Daily Paper", own, re.findall("<p>(.*?)</p>", body[0][1])[0], "Imprint 2020"])
    same = spark.createDataFrame([(i, "http://c.x/", page("<article><h1>t</h1><p>copy</p></article>")) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(same, "url", "html").collect()} == {"t\ncopy"}
    found = html.templates(spark.createDataFrame([("h", p) for p in pages], "host string, html string"), "html").first()
    valid, fixed = brute_deduce([p or "" for p in pages])
    assert found.main in valid and set(found.fixed) == fixed and len(fixed) == 3


# pipeline


def test_pipeline(spark, tmp_path):
    base, leak, shared = prose(150), prose(40), prose(80)
    good = [prose(120) for _ in range(12)]
    texts = [base, edited(base, 0.005), base, *good, f"{prose(100)} {leak}", f"{prose(90)} {shared}", f"{shared} {prose(95)}", "too short", " ".join(f"{w}%%%" for w in base.split()), None, ""]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "sentencepiece":
            assert docs.dtypes == before.dtypes
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "substring_dedup":
            cut = {r.doc_id: r.text for r in docs.collect()}
    ok = {*range(3, 15)}
    assert seen[0] == ok | {0, 1, 2, 15, 16, 17} and seen[1] == ok | {0, 15, 16, 17} and seen[2] == seen[1]
    assert seen[3] == seen[4] == ok | {0, 16, 17}
    assert shared in cut[16] and shared not in cut[17] and all(cut[i] == texts[i] for i in ok)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    for r in docs.collect():
        ids = [*library.encode(cut[r.doc_id]), library.eos_id()]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_rows_without_ids(spark, tmp_path):
    """Near copies with null ids: one stays; different texts with one id, or none, all stay whole."""
    base = prose(100)
    near_copy = f"{base} more."
    others = [prose(80) for _ in range(4)]
    texts = [base, near_copy, base, *others, others[0], None, None, ""]
    ids = [None, None, None, None, None, 5, 5, None, None, None, None]
    docs = documents(spark, texts, ids)
    stayed = corpus_pipeline.near_duplicates(spark, docs, "")
    got = sorted(r.text or "" for r in stayed.collect())
    one = [t for t in got if t in (base, near_copy)]
    assert len(one) == 1 and got == sorted([*one, *others, "", "", ""])
    judged = near.near_duplicates(docs.select("doc_id", "text"), "doc_id", "text").collect()
    assert sum(r.stays for r in judged if r.n_shingles) in (6, 7)  # five rows of other texts, and one text of the group, which may be two equal rows
    cut = passages.without_repeats(documents(spark, others, [None] * 4), "doc_id", "text").collect()
    assert sorted(r.text for r in cut) == sorted(others)


def test_many_rows_without_ids(spark):
    """The hash of a text, all of it, tells rows without an id apart: no clean text is cut by another's passages."""
    rng = random.Random(11)
    shared = prose(60, rng)
    clean = [" ".join(rng.choice(VOCAB) for _ in range(70)) for _ in range(3000)]
    dirty = [f"{' '.join(rng.choice(VOCAB) for _ in range(10))} {shared} x{i}" for i in range(3000)]
    out = passages.without_repeats(documents(spark, clean + dirty, [None] * 6000), "doc_id", "text").collect()
    assert len(out) == 6000 and set(clean) <= {r.text for r in out}
    assert sum(shared in r.text for r in out) == 1


def test_leaks_of_repeated_rows(spark):
    leak = prose(12)
    texts = [leak, leak, None, None, "", f"x {leak}"]
    ids = [1, 1, None, None, None, 1]
    bench = spark.createDataFrame([(7, leak)], "item_id long, text string")
    got = decontamination.report(documents(spark, texts, ids), "doc_id", "text", bench, "item_id", "text").collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in got) == [(0, 0, 0)] * 3 + [(1, 12, 12)] * 2 + [(1, 13, 12)]


def test_blocks_hold_every_open_pair(spark):
    """Members outside the largest component meet all members of a large node, each other included."""
    sigs = [bytes([i]) * 16 for i in range(200)]
    large = spark.createDataFrame([(1, 9, bytearray(s)) for s in sigs], "tree int, node long, sig binary")
    roots = spark.createDataFrame([(bytearray(s), bytearray(sigs[0])) for s in sigs[:150]], "node binary, root binary")
    nodes = {}
    for r in near._blocks(large, roots, 32, 4).collect():
        nodes.setdefault(r.node, set()).add(bytes(r.sig)[0])
    met = {(a, b) for m in nodes.values() for a in m for b in m if a < b}
    assert {(a, b) for a in range(200) for b in range(max(a + 1, 150), 200)} <= met
    assert max(map(len, nodes.values())) < 70 and sum(map(len, nodes.values())) <= 200 * 4 + 50 * 13


def test_texts_that_no_passage_asks_for_are_not_shuffled(spark):
    """Keys of the texts asked for are sent to the texts, whatever Spark would broadcast by itself."""
    docs = documents(spark, ["a b c", "d e f", None, "g h i"])
    keyed = passages._keyed(docs, "doc_id", "text")
    wanted = stored(keyed.where("text = 'd e f'").select("doc", "tag", F.lit(7).alias("asked")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = passages._asked(keyed, wanted)
        assert [(r.text, r.asked) for r in met.collect()] == [("d e f", 7)]
        plan = met._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and plan.index("BroadcastHashJoin") > plan.index("SortMergeJoin") and "LeftSemi" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_runs_hash_the_same_wherever_they_are():
    values = np.random.default_rng(2).integers(0, 1 << 63, 400, dtype=np.uint64)
    values[300:390] = values[17:107]
    for width in (6, 35, 50, 70):
        runs = passages._runs(values, width)
        assert len(runs) == 401 - width and (runs[17 : 108 - width] == runs[300 : 391 - width]).all()
        assert len(np.unique(runs)) == len(runs) - (91 - width)
    assert len(passages._runs(values[:20], 35)) == 0


def test_cuts_of_hot_texts_come_in_small_batches():
    """A long text that hundreds of copies ask for whole: what is handed on together is bounded by its bytes."""
    text = prose(10_000)
    hashes = words(np.frombuffer(text.lower().encode(), dtype=np.uint8), np.array([0, len(text)])).hashes().astype(np.uint32)
    asked = [[{"chain": lot * 100 + i, "side": "b", "lo": i, "hi": 20_000} for i in range(100)] for lot in range(6)]
    kind = pa.list_(pa.struct([("chain", pa.int64()), ("side", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))
    given = pa.RecordBatch.from_arrays([pa.array([*asked, []], kind), pa.array([text] * 6 + [None])], names=["asked", "text"])
    made = list(passages._cuts(iter([given.slice(0, 2), given.slice(2)])))
    assert max(b.nbytes for b in made) < passages.CUT_BYTES + 100_000
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["chain"] for r in rows] == list(range(600))
    assert all(r["cut"] == hashes[r["lo"] :].tobytes() for r in rows)
