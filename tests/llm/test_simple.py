"""Sharding, token counts, URL rules and SentencePiece on small awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraframe.llm import pieces, sharding, tokens, urls

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = [
    None, "", " ", "a", "abc  def\n\n x ", "<|endoftext|> a <|endoftext|>b", "\xa0a \xa0b", "a\x1c b \x1f", "don't 've 12ab $$ ..",
    "日本語 テキスト 😀 é\u0301", "▁▁x ▁ <s> </s> <unk> <0x0A>", "word " * 20_000, "x" * 30_000, " " * 3000, "a\x00b\r\n", "\u2581",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i % 15, t, "kept") for i, t in enumerate(ODD * 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def brute_table(shards, size):
    out, free, turn = {}, size, 0
    lists = {}
    for s in sorted(shards):
        offset = int(hashlib.sha256(f"offset\x00{s}".encode()).hexdigest()[:15], 16) % size
        skip = int(hashlib.sha256(f"skip\x00{s}".encode()).hexdigest()[:15], 16) % (size - 1) + 1
        lists[s] = iter([(offset + j * skip) % size for j in range(size)])
    while free:
        s = sorted(shards)[turn % len(shards)]
        turn += 1
        slot = next(x for x in lists[s] if x not in out)
        out[slot] = s
        free -= 1
    return [out[i] for i in range(size)]


def test_table_against_turns():
    shards = [f"s{i}" for i in (5, 3, 1, 4, 2)]
    assert [shards[i] for i in sharding.lookup_table(shards, 211)] == brute_table(shards, 211)


def test_table_is_even_and_stable():
    shards = [f"s{i}" for i in range(40)]
    before = sharding.lookup_table(shards, 65_537)
    share = Counter(before)
    assert max(share.values()) - min(share.values()) <= 1
    after = sharding.lookup_table(shards[:-1], 65_537)
    moved = sum(shards[a] != shards[b] for a, b in zip(before, after, strict=True) if a != 39)
    assert moved < 0.06 * 65_537
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)
    with pytest.raises(ValueError):
        sharding.lookup_table([], 211)


def test_place(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, "")], "k long, shard string")
    got = sharding.place(df, ["k"], ["x", "y"], 211).collect()
    assert len(got) == 5 and set(got[0].asDict()) == {"k", "slot", "shard"}
    assert len({(r.k, r.slot, r.shard) for r in got}) == 3
    assert sharding.place(df.limit(0), ["k"], ["x"], 211).count() == 0
    digest = int(hashlib.md5(b"v1").hexdigest()[:15], 16) % 211
    assert {r.slot for r in got if r.k == 1} == {digest}


def test_write_shards(spark, tmp_path):
    df = spark.range(500).withColumn("t", F.lit("x"))
    placed = sharding.place(df, ["id"], ["x", "y", "z"], 211)
    sharding.write_shards(placed, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("id", "shard").collect())) == sorted(map(tuple, placed.select("id", "shard").collect()))


def test_token_counts(spark, odd):
    counter = tokens.Counter(BPE)
    want = sorted((i % 15, len((t or "").encode()), len(counter.tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(ODD * 2))
    got = tokens.count_tokens(odd, "text", BPE)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert sorted(map(tuple, got.collect())) == want
    assert tokens.count_tokens(odd.limit(0), "text", BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1'.,$ \n\t\xa0\x1c\u3000é<|endoftext|>sS"), max_size=60))
def test_parts_add_up(text):
    counter = test_parts_add_up.__dict__.setdefault("counter", tokens.Counter(BPE))
    assert "".join(tokens.parts(text)) == text
    assert counter.counts([text])[0] == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


def test_balanced():
    got = list(tokens.balanced(["a" * 5, "b" * 20, "c", "d"], 10))
    assert got == [["a" * 5], ["b" * 20], ["c", "d"]]


def brute_fits(glob: str, host: str, path: str) -> bool:
    h, _, p = glob.partition("/")
    pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in f"{h}\x00/{p}")
    return re.fullmatch(pattern, f".{host}\x00{path}", re.S) is not None


def test_automaton_against_patterns():
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab*?.") for _ in range(rng.randint(1, 9))) + "/" + "".join(rng.choice("ab*?/") for _ in range(rng.randint(0, 30))) for _ in range(80)]
    automaton = urls.Automaton([urls.glob_rule("block", g) for g in globs])
    assert automaton.words > 2
    where = [("".join(rng.choice("ab.") for _ in range(rng.randint(0, 9))), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 12)))) for _ in range(200)]
    raw = [f".{h}\x00{p}".encode() for h, p in where]
    codes = np.full((len(raw), max(map(len, raw)) + 1), 256, dtype=np.uint16)
    for i, r in enumerate(raw):
        codes[i, : len(r)] = list(r)
    fits = automaton.fits(np.ascontiguousarray(codes.T))
    assert fits.any()
    for g, row in zip(globs, fits, strict=True):
        assert row.tolist() == [brute_fits(g, h, p) for h, p in where], g


def test_urls(spark):
    rules = [urls.host_path_rule(v, r) for v, r in (("allow", "com/"), ("block", "example.com/en/"), ("block", "n*t/"))]
    rules += [urls.glob_rule("block", "*.spam*/*"), urls.glob_rule("allow", "*.spam*/ok/*")]
    cases = {
        "http://A.Example.COM/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
        "http://notexample.com": ("notexample.com", "", None, "allow"),
        "http://xcom/": ("xcom", "/", None, "allow"),
        "http://spam.de/a": ("spam.de", "/a", None, "block"),
        "http://spam.de/ok/a": ("spam.de", "/ok/a", None, "allow"),
        "http://net/": ("net", "/", None, "allow"),
        "http://a?x://b/c": ("a", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://É.com/" + "p" * 50_000: ("É.com", "/" + "p" * 50_000, "com/", "allow"),
    }
    df = spark.createDataFrame([(u, "clash") for u in cases] * 2, "url string, rule string")
    got = urls.judge_urls(df, "url", rules).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url]
    assert {r.verdict for r in urls.judge_urls(df, "url", [], "block").collect()} == {"block"}
    assert urls.judge_urls(df.limit(0), "url", rules).count() == 0


def test_pieces(spark, odd):
    library = pieces.Vocabulary(PIECES).library
    want = sorted((i % 15, [*library.encode(t or ""), library.eos_id()]) for i, t in enumerate(ODD * 2))
    coded = pieces.encode(odd, "text", PIECES).drop("n_tokens")
    back = pieces.decode(coded, "ids", PIECES)
    got = back.collect()
    assert sorted((r.doc_id, r.ids) for r in got) == want
    for r in got:
        assert r.decoded == library.decode(r.ids)
    row = back.where("size(ids) > 5").select("ids", "decoded", *pieces.digests(back)).first()
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, row.ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest() and row.n_tokens == len(row.ids)
    assert pieces.decode(pieces.encode(odd.limit(0), "text", PIECES), "ids", PIECES).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abethin ▁\n1é日😀\u0301<s>"), max_size=40), max_size=5))
def test_agenda_against_library(texts):
    encoder = test_agenda_against_library.__dict__.setdefault("encoder", pieces.Encoder(PIECES))
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == encoder.v.library.encode(texts)
    assert encoder.v.decode(ids.astype(np.int64), at).to_pylist() == [encoder.v.library.decode(x) for x in encoder.v.library.encode(texts)]


def test_decode_of_any_ids():
    v = pieces.Vocabulary(PIECES)
    byte = v.bytes_at
    lists = [[0, 5], [5, 0], [], [2], [byte[0xE6], byte[0x97]], [byte[0xE6], byte[0x97], byte[0xA5], byte[0xA5]], [byte[255], 300, byte[0xC3]], [259, 300]]
    lists = [[int(x) for x in y] for y in lists]
    flat, at = np.array([x for y in lists for x in y], dtype=np.int64), np.r_[0, np.cumsum([len(y) for y in lists])]
    assert v.decode(flat, at).to_pylist() == [v.library.decode(y) for y in lists]
    assert isinstance(v.decode(flat[:0], np.zeros(1, dtype=np.int64)), pa.Array)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    (tmp_path / "m.model").write_bytes(m.SerializeToString())
    with pytest.raises((ValueError, RuntimeError)):
        pieces.Vocabulary(str(tmp_path / "m.model"))
