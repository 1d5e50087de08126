"""Keyword ranking by BM25 with Lucene's idf, over lower-cased letter and digit runs: in place, or from a stored index."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.plan import computed_once
from fathom.functions.text import tokens

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    """The query's distinct tokens, in order."""
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in query.lower())
    return list(dict.fromkeys(re.split(r" +", kept.strip()))) if kept.strip() else []


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _weight(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def matches(df: DataFrame, query: str, id_col: str = "id", text_col: str = "content", operator: str = "and", stats_of: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """All rows that hold the query's terms (all of them, or any): (id, score).

    Terms are counted in place, without a posting per word, so a query costs two scans and an aggregate of one row;
    document counts and lengths come from stats_of (default: df). A query without terms matches nothing.
    """
    if operator not in ("and", "or"):
        raise ValueError("operator is and or or")
    terms = query_terms(query)

    def counted(frame: DataFrame, *cols: Column) -> DataFrame:
        held = computed_once(frame.select(*cols, F.col(text_col).alias("__x")), __t=tokens(F.col("__x"))).drop("__x")
        return held.select(*[c for c in held.columns if c != "__t"], F.size("__t").alias("__dl"), *[F.size(F.filter("__t", _equals(t))).alias(f"__tf{i}") for i, t in enumerate(terms)])

    rows = counted(df, F.col(id_col).alias("id"))
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).where("false")
    whole = counted(stats_of if stats_of is not None else df)
    stats = whole.agg(F.count(F.lit(1)).alias("n"), F.avg("__dl").alias("avgdl"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    held = [F.col(f"__tf{i}") > 0 for i in range(len(terms))]
    test = held[0]
    for h in held[1:]:
        test = test & h if operator == "and" else test | h
    one = F.broadcast(stats)  # a single row
    scored = rows.where(test).join(one, F.lit(True))
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + _idf(F.col("n"), F.col(f"df{i}")) * _weight(F.col(f"__tf{i}"), F.col("__dl"), F.col("avgdl"), k1, b)
    return scored.select("id", score.alias("score"))


def _equals(term: str):
    return lambda x: x == F.lit(term)


def keyword_ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k matches with their place as score: (id, bm25, rank, score); score is (total - rank) / total with ranks
    from 0, total being the number of all matches."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    top = found.select("id", F.col("score").alias("bm25")).orderBy(F.col("bm25").desc(), "id").limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("bm25").desc(), "id")) - 1).join(F.broadcast(total), F.lit(True))
    share = (F.col("total") - F.col("rank")) / F.col("total")
    return ranked.select("id", "bm25", "rank", F.when(share > 0, share).otherwise(1 / (F.col("rank") + 1.0)).alias("score"), "total")


def _tokenized(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return computed_once(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__x")), t=tokens(F.col("__x"))).drop("__x")


def postings(df: DataFrame, id_col: str = "id", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Rows (term, id, tf, dl) and rows (term, df), for many queries; both can be written and bucketed by term."""
    held = _tokenized(df, id_col, text_col)
    tf = held.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return tf, tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def batch(queries: DataFrame, df: DataFrame, k: int, query_id: str = "query_id", query_text: str = "text", id_col: str = "id", text_col: str = "content", operator: str = "and", k1: float = K1, b: float = B) -> DataFrame:
    """The k best rows for each query: (query_id, id, score, rank), by joining query terms to postings.

    Only postings of terms that some query holds leave the scan's tasks; sizes decide whether terms are broadcast.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    held = _tokenized(df, id_col, text_col)
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl"))
    words = held.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = words.groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    # Every row counts; naming tf keeps its column here too, so that both uses of tf share one shuffle.
    df_ = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    hits = tf.join(asked, "term").join(df_, "term").join(F.broadcast(stats), F.lit(True))
    scored = hits.groupBy("query_id", "id").agg(F.sum(_idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("score"), F.count(F.lit(1)).alias("hit"))
    if operator == "and":
        scored = scored.join(wanted, "query_id").where("hit = terms")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


#: Buckets of terms in a stored index: a query reads the buckets of its terms, and in them the row groups that may hold these.
TERM_BUCKETS = 64


def _term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class KeywordIndex:
    """Stored postings of a table: rows (term, id, tf, dl) by bucket of the term and sorted by it, and the table's numbers."""

    postings: DataFrame
    n: int
    avgdl: float
    buckets: int

    @classmethod
    def write(cls, df: DataFrame, path: str, id_col: str = "id", text_col: str = "content", buckets: int = TERM_BUCKETS) -> KeywordIndex:
        """Tokenises every row once. Postings of a frequent term are split over tasks, so its bucket has several files."""
        spark = df.sparkSession
        tf, _ = postings(df, id_col, text_col)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = tf.withColumn("bucket", _term_bucket(F.col("term"), buckets))
        rows = rows.repartitionByRange(parts, "bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        lengths = _tokenized(df, id_col, text_col).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl"))
        lengths.select("n", F.coalesce("avgdl", F.lit(0.0)).alias("avgdl"), F.lit(buckets).alias("buckets"), F.lit(json.dumps(dict(tf.dtypes))).alias("kinds")).write.mode("overwrite").parquet(f"{path}/numbers")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> KeywordIndex:
        about = spark.read.parquet(f"{path}/numbers").first()
        kinds = json.loads(about["kinds"])
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("id", "term", "dl", "tf")) + ", bucket int"
        return cls(spark.read.schema(schema).parquet(f"{path}/postings"), about["n"], about["avgdl"], about["buckets"])

    def of_terms(self, terms: list[str]) -> DataFrame:
        """Postings of a query's terms: other buckets are not read, and of theirs only what may hold the terms."""
        spark = self.postings.sparkSession
        own = spark.createDataFrame([(t,) for t in terms], "term string").select(_term_bucket(F.col("term"), self.buckets).alias("b")).distinct()
        return self.postings.where(F.col("bucket").isin(sorted(r["b"] for r in own.collect())) & F.col("term").isin(terms))

    def matches(self, query: str, operator: str = "and", pool: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """As matches() of this module over the indexed table, cut to the ids of `pool` if there is one."""
        if operator not in ("and", "or"):
            raise ValueError("operator is and or or")
        terms = query_terms(query)
        if not terms:
            return self.postings.select("id", F.lit(0.0).alias("score")).where("false")
        hits = self.of_terms(terms)
        held = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)]
        counts = hits.agg(*[F.count_if(F.col("term") == t).alias(f"df{i}") for i, t in enumerate(terms)])
        rows = hits.groupBy("id", "dl").agg(*held)
        if operator == "and":
            for i in range(len(terms)):
                rows = rows.where(F.col(f"tf{i}").isNotNull())
        if pool is not None:
            rows = rows.join(pool.select("id"), "id", "left_semi")
        rows = rows.join(F.broadcast(counts), F.lit(True))  # a single row
        score = F.lit(0.0)
        for i in range(len(terms)):
            part = _idf(F.lit(self.n), F.col(f"df{i}")) * _weight(F.col(f"tf{i}"), F.col("dl"), F.lit(float(self.avgdl)), k1, b)
            score = score + F.coalesce(part, F.lit(0.0))
        return rows.select("id", score.alias("score"))

    def batch(self, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "text", operator: str = "and", k1: float = K1, b: float = B) -> DataFrame:
        """As batch() of this module over the indexed table: no text is read, and postings meet the queries' terms by a join."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
        wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
        terms = asked.select("term", _term_bucket(F.col("term"), self.buckets).alias("bucket")).distinct()
        tf = self.postings.join(terms, ["bucket", "term"], "left_semi").select("id", "term", "tf", "dl")
        # Every posting counts; naming tf keeps its column here too, so that both uses of the join share one shuffle.
        counts = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
        hits = tf.join(asked, "term").join(counts, "term")
        weight = _idf(F.lit(self.n), F.col("df")) * _weight(F.col("tf"), F.col("dl"), F.lit(float(self.avgdl)), k1, b)
        scored = hits.groupBy("query_id", "id").agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("hit"))
        if operator == "and":
            scored = scored.join(wanted, "query_id").where("hit = terms")
        w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
