"""A training corpus from raw documents: five stages, each an operator of ``terraframe.llm``.

Each stage takes all documents that its predecessor kept, as Parquet, and its
decisions take effect: rejected rows and cut lines or passages are gone. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import decontamination, near, passages, pieces, quality
from terraframe.llm.queries import vocabulary
from terraframe.llm.storage import small, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them.

    A text without failing lines is unchanged; ``n_chars`` is that of the text that stays.
    """
    judged = quality.judge(docs, "text").where("kept")
    return _with_text(judged, "clean_text").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest id.

    Null ids come last; where ids are null or repeated, the text with the
    smallest hash stays, and of rows that share id and text any one. Rows of
    one id with texts that are no near duplicates all stay, and so do texts
    without words, which are in no group.
    """
    judged = near.near_duplicates(docs.select("doc_id", "text"), "doc_id", "text", width=5, percent=80)
    judged = stored(judged.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), "stays", "n_shingles"))
    gone = stored(judged.where("NOT stays").select("__id", "__tag").distinct())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tag"))
    left = docs.join(small(gone), same, "left_anti")
    copies = judged.where("stays AND n_shingles > 0").groupBy("__id", "__tag").count().where("count > 1").select("__id", "__tag")
    copies = stored(copies)
    if copies.isEmpty():
        return left
    first = left.join(small(copies), same, "left_semi").withColumn("__hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__hash"])
    return left.join(small(copies), same, "left_anti").unionByName(first.drop("__hash"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document or place has; texts that are only that go."""
    cut = passages.without_repeats(docs.withColumn("__length", F.char_length("text")), "doc_id", "text")
    return cut.withColumn("n_chars", _length(F.char_length("text") < F.col("__length"))).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs, "doc_id", "text", bench, "item_id", "text")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text with an end id, and what they decode to, as digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    model = vocabulary("piece_bpe_32k.model")
    coded = pieces.recode(docs.select("doc_id", "text"), "text", model)
    return coded.select("doc_id", *pieces.digests(coded))


def _with_text(df: DataFrame, new: str) -> DataFrame:
    changed = ~F.col("text").eqNullSafe(F.col(new)) & F.col("text").isNotNull()
    text = F.when(changed, F.col(new)).otherwise(F.col("text"))
    return df.withColumn("__changed", changed).withColumn("text", text).withColumn("n_chars", _length(F.col("__changed")))


def _length(changed):
    return F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Chained passages and SentencePiece ids are no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
