"""Corpus pipeline: language ID, exact dedup, near dedup, source mix, tokenisation; each stage reads what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, exactdedup, jaccard, langid, mixing
from fathom.llm.runtime import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the documents' own labels; texts that are null or have no letter go."""
    return langid.known_language(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share at least 0.8 of their 5-word shingles, or are within op6's radius."""
    return jaccard.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; n_chars stays that of the whole text."""
    return mixing.mixture(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, with their number and whether they decode to the text's own bytes."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    keyed = docs.select(F.struct("doc_id", F.sha2("text", 256).alias("sha")).alias("row"), "text")
    done = bpe.round_trip(keyed, ranks, pattern, id_col="row")
    same = F.sha2("decoded", 256) == F.coalesce("row.sha", F.sha2(F.lit("").cast("binary"), 256))
    return done.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("exact"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("tokenize", tokenize),
]

#: SQL cannot express the first, third and last stage; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
