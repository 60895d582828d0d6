"""The registered forms of the operators: whole tables in, the agreed columns out, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import decontamination, html, katz, near, negatives, passages, pieces, quality, sharding, tokens, toxicity, trie, urls
from terraframe.llm.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


SHARDS = tuple(f"shard-{i:03d}" for i in range(256))


@query("op1_sharding")
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's slot and shard, by its id; null ids share one place."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return sharding.place(docs, ["doc_id"], SHARDS)


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = tokens.count_tokens(docs, "text", vocabulary("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Globs for urls that no rule above decides: sellers' and spam hosts, tracking and listing paths.
URL_GLOBS = (
    ("block", "*.spam*/*"), ("block", "*spam-farm.*/*"), ("block", "*cheap-pills.*/*"), ("block", "*.ads.*/*"),
    ("block", "*.doubleclick.*/*"), ("block", "*/*/wp-login.php*"), ("block", "*/*/cart/*"), ("block", "*/*/search/*"),
    ("block", "*/wp-login.php*"), ("block", "*/cart/*"), ("block", "*/search/*"),
    ("allow", "*.gov.*/*"), ("allow", "*.edu.*/*"),
)

_URL_SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest
  FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)),
judged AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM judged)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN path LIKE '/%' AND (host LIKE '%.doubleclick.%' OR '.' || host LIKE '%.doubleclick.%') THEN 'block'
    WHEN path LIKE '/%/wp-login.php%' OR path LIKE '/wp-login.php%' OR path LIKE '/cart/%' OR path LIKE '/search/%' THEN 'block'
    WHEN path LIKE '/%' AND '.' || host LIKE '%cheap-pills.%' THEN 'block'
    WHEN path LIKE '/%' AND '.' || host LIKE '%spam-farm.%' THEN 'block'
    WHEN path LIKE '/%/search/%' THEN 'block'
    WHEN path LIKE '/%/cart/%' THEN 'block'
    WHEN path LIKE '/%' AND '.' || host LIKE '%.spam%' THEN 'block'
    WHEN path LIKE '/%' AND '.' || host LIKE '%.ads.%' THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op3_url_filters", _URL_SQL)
def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = [urls.host_path_rule(v, r) for v, r in URL_RULES] + [urls.glob_rule(v, g) for v, g in URL_GLOBS]
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge_urls(pages, "url", rules).select("page_id", "host", "path", "rule", "verdict")


_STOCK = " OR ".join(f"contains(lower(line), '{p}')" for p in quality.BOILERPLATE)
_QUALITY_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, string_split(t, chr(10)) AS lines FROM texts),
windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS w
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM parts)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, generate_series(0, 7) AS g(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(lines) AS line FROM parts),
counted AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '[|»›•·]')) AS bars,
         len(regexp_extract_all(line, '!!')) AS shouts
  FROM lines),
judged AS (
  SELECT doc_id, line, n, n > 0 AND (
    (symbols >= 3 AND symbols > 0.2 * n) OR (bars >= 3 AND bars * 3 >= n) OR (shouts >= 3 AND shouts * 5 >= n)
    OR (n >= 20 AND NOT regexp_matches(line, '[.!?]')) OR (n <= 30 AND ({_STOCK}))) AS fails
  FROM counted),
lost AS (
  SELECT doc_id, sum(CASE WHEN fails THEN n ELSE 0 END) AS n_lost,
         count(line) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup
  FROM judged GROUP BY doc_id),
base AS (
  SELECT p.doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, n_dup AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         n_lost
  FROM parts p JOIN lost l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       n_lost::BIGINT AS n_lost_words, NOT base_failed AND n_lost <= 0.25 * n_words AS kept
FROM failed
"""


@query("op4_quality_rules", _QUALITY_SQL)
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judge(docs, "text").select(*columns, "base_failed", "n_lost_words", "kept")


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = pieces.recode(docs, "text", model)
    return coded.select("doc_id", *pieces.digests(coded))


_LEAK_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(words, s, s + 9) AS w
  FROM (SELECT item_id, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS s FROM items WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT len(w) AS n FROM windows),
runs AS (
  SELECT doc_id, s, n, list_slice(words, s, s + n - 1) AS w
  FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS s FROM low, lengths)),
hits AS (SELECT doc_id, s, n, item_id FROM runs JOIN windows USING (w)),
words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""


@query("op7_benchmark_decontamination", _LEAK_SQL)
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.report(docs, "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_NEAR_SQL = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(words, s, s + 3) AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 3))) AS s FROM low WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM low LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""


@query("op10_minhash_near_dedup", _NEAR_SQL)
def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near.near_duplicates(docs, "doc_id", "text", width=4).drop("n_links", "tag", "stays")


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each part of a passage of 50 words or more that an earlier document (or place) has already."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return passages.passages(docs, "doc_id", "text").drop("tag").withColumn("n_words", F.col("end") - F.col("start"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    def held_out(c) -> Column:
        return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 5 == 0

    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~held_out("doc_id"))
    model = toxicity.fit(docs, "doc_id", "text", labels, "toxic")
    out = toxicity.score(docs, "text", model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html.extract(pages, "url", "html").withColumn("n_chars", F.char_length("text").cast("long"))


_NEGATIVES_SQL = """
WITH valid AS (
  SELECT vec_id, row_number() OVER () AS uid, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid AS other, b.vec_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM valid a, valid b WHERE a.vec_id % 100 = 0 AND a.uid <> b.uid),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
   AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


@query("op12_hard_negatives", _NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; a seventh of the labels is shifted by one."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, "vec_id", "embedding", shifted, F.col("vec_id") % 100 == 0)


_TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c:
      list_prepend(ascii(c)::BIGINT, list_transform(range(8), lambda i: -1::BIGINT))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS seg, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > h),
seqs AS (
  SELECT c.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY seg, pos) FILTER (r.pos IS NOT NULL), []) AS seq
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
members AS (SELECT conv_id, len(seq) AS size, d, list_slice(seq, 1, d) AS prefix FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT prefix, d, min(conv_id) AS conv, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends
  FROM members GROUP BY prefix, d),
tied AS (
  SELECT n.*, p.conv AS parent, n.n_convs AS m,
         CASE WHEN n.d = 0 THEN 0 ELSE len(regexp_extract_all(n.prefix[n.d].text, '[^ 	-
]+')) END AS words
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = list_slice(n.prefix, 1, n.d - 1)),
kids AS (SELECT parent, d - 1 AS d, count(*) AS n FROM tied WHERE d > 0 GROUP BY ALL),
own AS (SELECT t.*, coalesce(k.n, 0) AS n_children, (m - 1) * words AS saved FROM tied t LEFT JOIN kids k ON k.parent = t.conv AND k.d = t.d),
sums AS (
  SELECT list_slice(prefix, 1, up) AS prefix, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM own) GROUP BY 1)
SELECT conv AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM own JOIN sums USING (prefix)
"""


@query("op11_conversation_trie", _TRIE_SQL)
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations begin with up to three turns of the one whose id is the next lower multiple of 20. Null ids take no part.

    Turns with the same number follow each other by role and hash.
    """
    source = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    keys = trie.turn_keys(source, "conv_id", "role", "text", "turn", "role")
    turns = trie.numbered(keys, F.asc_nulls_first("turn"), F.coalesce("role", F.lit("")), "t1", "t2")
    convs = stored(turns.where("pos = 1").select("conv"))
    h = F.crc32(F.col("conv").cast("string")) % 4
    columns = ["conv", "seg", "pos", "t1", "t2", "words"]
    own = turns.where(F.col("pos") > h).withColumn("seg", F.lit(1)).select(*columns)
    heads = turns.where("pos <= 3 AND conv % 20 = 0").select(F.col("conv").alias("head"), "pos", "t1", "t2", "words")
    wanted = convs.where(h > 0).select("conv", (F.col("conv") - F.col("conv") % 20).alias("head"), h.alias("h"))
    begun = wanted.join(heads, "head").where("pos <= h").withColumn("seg", F.lit(0)).select(*columns)
    return trie.prefix_trie(own.unionByName(begun), convs, "seg", "pos")


@query("op13_lm_scores")
def op13_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from nine tenths of the documents, by their id, and scores all."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return katz.score(docs, "doc_id", "text", ~held_out).withColumn("held_out", held_out)
