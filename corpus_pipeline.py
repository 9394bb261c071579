"""A corpus from raw documents to packed sequences: quality rules, near duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm import packing, quality, secrets, simhash, substrings
from lipika.llm.common import scratch, stash, table

#: Words of a passage that must not repeat in later documents.
PASSAGE_WORDS = 50


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.judge_quality(docs, labels).where("_quality.kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id."""
    return simhash.keep_one(docs, words_per_shingle=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE_WORDS words or more that a document with a smaller doc_id has; n_chars follows."""
    out = substrings.dedup_substrings(docs, window=PASSAGE_WORDS, rounds=6, emit="text", names=("_lipika_words", "_lipika_removed"), block_bytes=2 << 20)
    return out.withColumn("n_chars", F.when(F.col("_lipika_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; n_chars follows."""
    found = secrets.scan_secrets(docs, names=("_lipika_base_spans", "_lipika_spans"))
    hit = F.size("_lipika_spans") > 0
    text = F.when(hit, secrets.redact(F.col("text"), F.col("_lipika_spans"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, put in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("packing", packing_stage),
]

#: SQL expresses none of the fitted cutoffs, fingerprints and tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written before the next one reads it, and deleted once that has."""
    docs = table(spark, sf_dir, "documents")
    with scratch() as keep:
        for name, stage in STAGES[:-1]:
            docs = stash(stage(spark, docs, sf_dir), name)
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
