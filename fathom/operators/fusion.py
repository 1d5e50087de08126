"""Fusing ranked lists, and turning ranked chunks into ranked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(*lists: DataFrame, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of lists with (id, rank) and 1-based ranks: (id, score), score = sum of 1 / (k + rank).

    `by` names further key columns (a query's id) that all lists carry. One aggregation, no join.
    """
    every = None
    for x in lists:
        part = x.select(*by, "id", (1.0 / (F.lit(k) + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*by, "id").agg(F.sum("part").alias("score"))


def ranked(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds a 1-based rank by score, ties by id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")))


def documents(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The best chunk of each document: from (id, score, rank, parent_doc_id, chunk_index, ...) to one row per document,
    whose id is the parent's (the chunk's own where it has none) and whose chunk_id is the best chunk's.

    Best is the highest score, then the lowest rank, chunk_index and id. A minimum over structs with partial
    aggregation: no sort of a document's chunks.
    """
    doc = F.when(F.coalesce(F.col("parent_doc_id"), F.lit("")) != "", F.col("parent_doc_id")).otherwise(F.col("id").cast("string"))
    order = F.struct((-F.col("score")).alias("s"), F.col("rank").alias("r"), F.coalesce("chunk_index", F.lit(0.0)).alias("c"), F.col("id").alias("i"))
    best = chunks.groupBy(*by, doc.alias("doc_id")).agg(F.min(order).alias("b"))
    return best.select(*by, F.col("doc_id"), (-F.col("b.s")).alias("score"), F.col("b.r").alias("rank"), F.col("b.c").alias("chunk_index"), F.col("b.i").alias("chunk_id"))




def top_documents(docs: DataFrame, k: int) -> DataFrame:
    return docs.orderBy(F.col("score").desc(), "rank", "chunk_index", "chunk_id").limit(k)
