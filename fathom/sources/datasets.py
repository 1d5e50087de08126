"""Retrieval data sets and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import title_and_text

CORPUS = "_id string, title string, text string"
QUERIES = "_id string, text string"
QRELS = "`query-id` string, `corpus-id` string, score int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".tsv", ".csv")):
        return spark.read.schema(schema).option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    return spark.read.schema(schema).json(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content): title, blank line, text."""
    return _read(spark, path, CORPUS).select(F.col("_id").alias("doc_id"), title_and_text(F.col("title"), F.col("text")).alias("content"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, QUERIES).select(F.col("_id").alias("query_id"), "text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, score) with positive scores."""
    return _read(spark, path, QRELS).select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), "score").where("score > 0")


def write_reports(results: DataFrame, summary: DataFrame, path: str) -> None:
    """per_query as CSV and summary as JSON lines, in folders under path."""
    results.write.mode("overwrite").option("header", True).csv(f"{path}/per_query")
    summary.write.mode("overwrite").json(f"{path}/summary")


def markdown(summary: DataFrame) -> str:
    """The summary, a row per mode, as a Markdown table."""
    rows = [r.asDict() for r in summary.orderBy("mode").collect()]
    cols = summary.columns
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else json.dumps(v) if isinstance(v, (dict, list)) else str(v)
    return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows)]) + "\n"
