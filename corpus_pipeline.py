"""The corpus pipeline: every stage works on what the one before it kept.

Language identification and the quality classifier drop the documents they
reject, the n-gram join leaves one document of each group of near copies, the
suffix dedup cuts passages that repeat, and the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions.lineage import shuffles_dropped
from fleetgauge.llm import language_id, ngram_join, packing, quality_crf, suffix_dedup
from fleetgauge.llm.common import held_out, new_folder, small_batches, table, tokenizer_path

#: A text whose n-gram ranking lies farther than this from every language is in none of them.
MIN_NEARNESS = 0.2
MIN_QUALITY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in none of the learned languages go: no letter, or too far from every profile."""
    small_batches(spark)
    learned = language_id.fit(docs.filter(~held_out()))
    out = language_id.identify(docs, learned)
    return out.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_NEARNESS)).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely bad than good go."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    field = quality_crf.fit(docs.filter(~held_out()), labels)
    return quality_crf.score(docs, field).filter(F.col("score") >= MIN_QUALITY).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once; documents without an id stay."""
    small_batches(spark)
    groups = ngram_join.near_groups(docs, n=5, num=80, den=100)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that also start in an earlier document are cut; documents of which nothing is left go."""
    small_batches(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = suffix_dedup.repeated_spans(docs, span=50, whole_characters=True, carry=("n_chars", *rest))
    cut = F.size("spans") > 0
    text = F.col("kept").cast("string")
    out = out.withColumn("__text", text).filter(~cut | (F.trim(F.regexp_replace("__text", "\\s", "")) != ""))
    return out.withColumn("text", F.col("__text")).withColumn("n_chars", F.when(cut, F.length("__text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1,024 tokens, along the curve."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), length=1024, closing=0)


STAGES = [("language_id", identify_language), ("quality_classifier", classify_quality), ("ngram_jaccard_join", drop_near_copies),
          ("suffix_array_dedup", cut_repeats), ("packing", pack_sequences)]
#: SQL cannot express the learned stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark)
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        with shuffles_dropped(spark):
            kept.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
