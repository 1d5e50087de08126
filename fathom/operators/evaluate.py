"""Retrieval quality: rankings against graded judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_judged(qrels: DataFrame, corpus: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Judged documents that the corpus lacks."""
    return qrels.join(corpus.select(doc_col), doc_col, "left_anti")


def per_query(rankings: DataFrame, qrels: DataFrame, cut: int = 10, deep: int = 20) -> DataFrame:
    """From rankings (mode, query_id, doc_id, rank) and qrels (query_id, doc_id, score > 0), per mode and judged query:
    ndcg, mrr, recall at `cut`, recall_deep at `deep`, num_results and num_relevant. Queries without results score 0."""
    q = qrels.where("score > 0")
    gain = lambda s, r: (F.pow(F.lit(2.0), s) - 1) / F.log2(r + 1.0)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ideal = q.withColumn("r", F.row_number().over(w))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("r") <= cut, gain(F.col("score"), F.col("r")))).alias("idcg"), F.count(F.lit(1)).alias("num_relevant"))
    every = rankings.select("mode").distinct().join(ideal, F.lit(True))
    hits = rankings.join(q, ["query_id", "doc_id"], "left")
    hit = F.col("score").isNotNull()
    found = hits.groupBy("mode", "query_id").agg(
        F.coalesce(F.sum(F.when(hit & (F.col("rank") <= cut), gain(F.col("score"), F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.min(F.when(hit & (F.col("rank") <= cut), F.col("rank"))).alias("first"),
        F.count_if(hit & (F.col("rank") <= cut)).alias("hits"), F.count_if(hit & (F.col("rank") <= deep)).alias("deep"),
        F.count(F.lit(1)).alias("num_results"),
    )
    out = every.join(found, ["mode", "query_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "mode", "query_id", zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(1.0 / F.col("first")).alias("mrr"),
        zero(F.col("hits") / F.col("num_relevant")).alias("recall"), zero(F.col("deep") / F.col("num_relevant")).alias("recall_deep"),
        F.coalesce("num_results", F.lit(0)).alias("num_results"), "num_relevant",
    )


def summary(results: DataFrame) -> DataFrame:
    """Means per mode."""
    names = ("ndcg", "mrr", "recall", "recall_deep")
    return results.groupBy("mode").agg(*[F.avg(n).alias(f"mean_{n}") for n in names], F.avg("num_results").alias("mean_results"), F.count(F.lit(1)).alias("queries"))


def best_and_worst(results: DataFrame, n: int = 5) -> DataFrame:
    """Per mode the n best and n worst queries by (ndcg, mrr, recall, fewer results, id): adds side and place."""
    order = ["ndcg", "mrr", "recall"]
    best = Window.partitionBy("mode").orderBy(*[F.desc(c) for c in order], F.asc("num_results"), "query_id")
    worst = Window.partitionBy("mode").orderBy(*[F.asc(c) for c in order], F.desc("num_results"), "query_id")
    sides = [results.withColumns({"side": F.lit(s), "place": F.row_number().over(w)}).where(F.col("place") <= n) for s, w in (("best", best), ("worst", worst))]
    return sides[0].unionByName(sides[1])


def corpus_stats(chunks: DataFrame, doc_col: str = "source_doc_id", tokens: str = "token_count") -> DataFrame:
    """One row: documents, chunks, and mean, least and most tokens per chunk and chunks per document."""
    per_doc = chunks.groupBy(doc_col).agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("t"), F.min(tokens).alias("lo"), F.max(tokens).alias("hi"))
    return per_doc.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chunks"), (F.sum("t") / F.sum("n")).alias("avg_tokens"), F.min("lo").alias("min_tokens"),
        F.max("hi").alias("max_tokens"), F.avg("n").alias("avg_chunks"), F.min("n").alias("min_chunks"), F.max("n").alias("max_chunks"),
    )


def best_runs(runs: DataFrame) -> DataFrame:
    """From runs (run, ndcg, recall, qps, ingest_rate, elapsed): the best run of each metric; the least elapsed is best, ties go to the first name."""
    cols = []
    for metric, low in (("ndcg", False), ("recall", False), ("qps", False), ("ingest_rate", False), ("elapsed", True)):
        key = F.struct(F.col(metric) if low else -F.col(metric), "run")
        cols.append(F.min_by("run", key).alias(f"best_{metric}"))
    return runs.agg(*cols)
