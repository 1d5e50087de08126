"""Nearest-neighbour, keyword, hybrid and similar-document queries, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.embedding import stub_vector, stub_vector_of
from fathom.model import Collection, Field, Mode, SearchRequest, SimilarRequest
from fathom.operators import bm25, evaluate, filters, fusion, knn
from fathom.operators.filters import Filter, Match, Range
from fathom.operators.search import Searcher
from fathom.operators.chunking import fixed_windows
from fathom.plans.registry import query, table
from fathom.sources import scratch

K = 10
STUB_DIM = 16
_COS = "greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], q.v))"
_Q0 = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
_TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _tokens(col: str) -> str:
    return _TOKENS.format(col)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _vector_zero(df: DataFrame) -> list[float]:
    return df.where("id = 0").select("vector").head()[0]


def _knn(df: DataFrame, pool: DataFrame, metric: str = "cosine") -> DataFrame:
    near = knn.knn(pool, _vector_zero(df), K, metric=metric)
    return near.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def _knn_sql(where: str = "true", measure: str = _COS, order: str = "DESC") -> str:
    return f"WITH {_Q0} SELECT vec_id, round({measure}, 6) AS score FROM embeddings e, q WHERE {where} ORDER BY {measure} {order}, vec_id LIMIT {K}"


@query("knn_cosine_topk", _knn_sql())
def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    return _knn(df, df)


@query("knn_filtered_must", _knn_sql("label >= 2 AND label < 7"))
def knn_filtered_must(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    return _knn(df, filters.apply(df, Filter(must=(Range("label", gte=2, lt=7),))))


@query("knn_filtered_should_mustnot", _knn_sql("(label <= 1 OR label >= 6) AND label <> 8"))
def knn_filtered_should_mustnot(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    spec = Filter.parse({"should": [{"key": "label", "range": {"lte": 1}}, {"key": "label", "range": {"gte": 6}}], "must_not": [{"key": "label", "range": {"gt": 7, "lt": 9}}]})
    return _knn(df, filters.apply(df, spec))


@query("empty_filter", _knn_sql())
def empty_filter(spark: SparkSession, d: str) -> DataFrame:
    """A filter without conditions keeps every row."""
    df = _vectors(spark, d)
    return _knn(df, filters.apply(df, Filter.parse({"must": [], "should": [], "must_not": []})))


@query("knn_range", _knn_sql("label > 4"))
def knn_range(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    return _knn(df, filters.apply(df, Filter(must=(Range("label", gt=4),))))


@query("knn_inner_product", _knn_sql(measure="list_dot_product(e.embedding::DOUBLE[], q.v)"))
def knn_inner_product(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    return _knn(df, df, "ip")


@query("knn_l2", _knn_sql(measure="list_distance(e.embedding::DOUBLE[], q.v)", order="ASC"))
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    return _knn(df, df, "l2")


_BATCH = f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings {{where}}),
s AS (SELECT query_id, vec_id AS id, {_COS} AS score FROM embeddings e, q {{pairs}}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= {{k}}"""


@query("knn_batch_queries", _BATCH.format(where="WHERE vec_id % 20 = 0", pairs="", k=K))
def knn_batch_queries(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    q = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return knn.knn_batch(q, df, K).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("knn_self_join_topk", _BATCH.format(where="", pairs="WHERE query_id <> vec_id", k=3))
def knn_self_join_topk(spark: SparkSession, d: str) -> DataFrame:
    return knn.similar_pairs(_vectors(spark, d), 3).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def vector_collection(spark: SparkSession, d: str) -> Searcher:
    df = _vectors(spark, d).withColumn("id", F.col("id").cast("string"))
    df = df.select("id", F.lit("").alias("content"), F.lit(None).cast("map<string,string>").alias("tags"), F.lit(None).cast("map<string,double>").alias("numerics"), "vector", "label")
    return Searcher(df, Collection("vectors", (Field("label", "numeric"),), 64))


@query("similar_docs", f"WITH {_Q0} SELECT vec_id::VARCHAR AS id, round({_COS}, 6) AS score FROM embeddings e, q WHERE vec_id <> 0 ORDER BY {_COS} DESC, vec_id::VARCHAR LIMIT {K}")
def similar_docs(spark: SparkSession, d: str) -> DataFrame:
    hits = vector_collection(spark, d).similar("0", SimilarRequest(top_k=K)).hits
    return hits.select("id", F.round("score", 6).alias("score"))


@query(
    "similar_min_score",
    f"WITH {_Q0}, t AS (SELECT vec_id::VARCHAR AS id, {_COS} AS score FROM embeddings e, q WHERE vec_id <> 0 AND label < 5 ORDER BY score DESC, id LIMIT 50) SELECT id, round(score, 6) AS score FROM t WHERE score >= 0.25 ORDER BY score DESC, id LIMIT 20",
)
def similar_min_score(spark: SparkSession, d: str) -> DataFrame:
    request = SimilarRequest(Filter(must=(Range("label", lt=5),)), top_k=50, min_score=0.25)
    return vector_collection(spark, d).similar("0", request).hits.select("id", F.round("score", 6).alias("score"))


# Keyword search over documents.


def text_documents(spark: SparkSession, d: str) -> DataFrame:
    """documents as a collection: tags lang and source and numeric n_chars, promoted to columns so predicates reach the scan."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))


def _bm25_sql(terms: tuple[str, ...], operator: str, where: str = "true") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))" for i in range(len(terms)))
    test = f" {operator} ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""WITH tok AS (SELECT doc_id::VARCHAR AS id, lang, source, n_chars, {_tokens('text')} AS t FROM documents),
    d AS (SELECT id, lang, source, n_chars, len(t) AS dl, {tf} FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM d),
    m AS (SELECT id, {part} AS score FROM d, st WHERE ({test}) AND {where})"""


def _bm25_top(terms: tuple[str, ...], operator: str, where: str = "true") -> str:
    return _bm25_sql(terms, operator, where) + f" SELECT id, round(score, 6) AS score FROM m ORDER BY m.score DESC, id LIMIT {K}"


_INDEXES: dict[str, bm25.KeywordIndex] = {}


def keyword_index(spark: SparkSession, d: str, name: str, docs: DataFrame) -> bm25.KeywordIndex:
    """The stored postings of a table, as a collection keeps them: made by the first query, and anew if the files change."""
    key = f"{spark.sparkContext.applicationId} {scratch.state_of(spark, f'{d}/{name}.parquet')}"
    if key not in _INDEXES:
        _INDEXES[key] = bm25.KeywordIndex.write(docs.select("id", "content"), scratch.new_folder(spark, f"keywords-{name}"))
    return _INDEXES[key]


def _bm25(spark: SparkSession, d: str, text: str, operator: str, pool: DataFrame | None = None) -> DataFrame:
    found = keyword_index(spark, d, "documents", text_documents(spark, d)).matches(text, operator, pool)
    return found.orderBy(F.col("score").desc(), "id").limit(K).select("id", F.round("score", 6).alias("score"))


@query("bm25_and", _bm25_top(("the", "with", "and"), "AND"))
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, "The with, AND", "and")


@query("bm25_or", _bm25_top(("thention", "quever", "license"), "OR"))
def bm25_or(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, "thention quever license", "or")


@query("bm25_filtered", _bm25_top(("license", "the"), "AND", "lang = 'en' AND n_chars >= 500 AND source <> 'src3'"))
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    df = text_documents(spark, d)
    spec = Filter(must=(Match("lang", "en"), Range("n_chars", gte=500)), must_not=(Match("source", "src3"),))
    return _bm25(spark, d, "license the", "and", filters.apply(df, spec))


@query(
    "keyword_rank_score",
    _bm25_sql(("license", "the"), "AND")
    + ", r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, count(*) OVER () AS total FROM m) SELECT id, rank, total, round((total - rank)::DOUBLE / total, 6) AS score FROM r WHERE rank < 20",
)
def keyword_rank_score(spark: SparkSession, d: str) -> DataFrame:
    """Without stored postings: terms are counted in place."""
    found = bm25.matches(text_documents(spark, d), "license the")
    return bm25.keyword_ranked(found, 20).select("id", F.col("rank").cast("long").alias("rank"), "total", F.round("score", 6).alias("score"))


_QUERIES_SQL = f"SELECT item_id AS query_id, {_tokens('text')} AS words FROM benchmark"


@query(
    "bm25_batch",
    f"""WITH q AS ({_QUERIES_SQL}), a AS (SELECT DISTINCT query_id, unnest(words) AS term FROM q),
    tok AS (SELECT doc_id AS id, {_tokens('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
    p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok),
    tf AS (SELECT id, dl, p.term, count(*) AS tf FROM p WHERE p.term IN (SELECT term FROM a) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))) AS score
          FROM tf JOIN a USING (term) JOIN df USING (term), st GROUP BY query_id, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
    SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
)
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    """Whole benchmark texts as queries, against the stored postings."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    index = keyword_index(spark, d, "documents", text_documents(spark, d))
    index = bm25.KeywordIndex(index.postings.withColumn("id", F.col("id").cast(docs.schema["id"].dataType)), index.n, index.avgdl, index.buckets)
    return index.batch(q, 5, operator="or").select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_batch_whole")
def bm25_batch_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index: postings of the queries' terms are drawn from the texts; a test has the brute force."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return bm25.batch(q, docs, 5, operator="or").select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Fusion and the three modes.


@query(
    "rrf_fusion",
    f"""WITH {_Q0}, q1 AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1),
    a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings e, q),
    b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_COS.replace('q.v', 'q1.v')} DESC, vec_id) AS rank FROM embeddings e, q1),
    u AS (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100)
    SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY id""",
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    lists = []
    for own in (0, 1):
        v = df.where(F.col("id") == own).select("vector").head()[0]
        lists.append(knn.with_rank(knn.knn(df, v, 100), F.col("score").desc(), "id"))
    return fusion.rrf(*lists).select("id", F.round("score", 9).alias("score"))


def chunk_collection(spark: SparkSession, d: str) -> Searcher:
    """conversations as chunks of documents: a conversation is a document, a turn a chunk; stub vectors of the text."""
    t = table(spark, d, "conversations")
    df = t.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"), F.create_map(F.lit("role"), F.col("role")).alias("tags"),
        F.lit(None).cast("map<string,double>").alias("numerics"), stub_vector(F.col("text"), STUB_DIM).alias("vector"),
        F.col("conv_id").cast("string").alias("parent_doc_id"), F.col("turn").cast("double").alias("chunk_index"),
    )
    return Searcher(df, Collection("turns", (Field("role", "tag"),), STUB_DIM), embed_query=lambda q: stub_vector_of(q, STUB_DIM), keyword_index=lambda: keyword_index(spark, d, "conversations", df))


def window_collection(spark: SparkSession, d: str) -> Searcher:
    """documents cut into windows of words, as chunks of documents; keyword search counts in place."""
    c = fixed_windows(table(spark, d, "documents"), 128, 16, "doc_id", "text")
    df = c.select(
        F.col("chunk_id").alias("id"), "content", F.lit(None).cast("map<string,string>").alias("tags"), F.lit(None).cast("map<string,double>").alias("numerics"),
        stub_vector(F.col("content"), STUB_DIM).alias("vector"), F.col("source_doc_id").cast("string").alias("parent_doc_id"), F.col("chunk_idx").cast("double").alias("chunk_index"),
    )
    return Searcher(df, Collection("windows", (), STUB_DIM), embed_query=lambda q: stub_vector_of(q, STUB_DIM))


def _hex_number(block: str, k: str) -> str:
    byte = lambda b: f"('0x' || substr({block}, {k} * 8 + {2 * b + 1}, 2))::BIGINT"
    return f"(({byte(0)} + 256 * {byte(1)} + 65536 * {byte(2)} + 16777216 * {byte(3)})::DOUBLE / 4294967295.0::DOUBLE * 2 - 1)"


def stub_sql(text: str) -> str:
    """The stub vector of a text, before it is brought to unit length (cosines do not see the difference)."""
    blocks = [f"sha256(unhex(sha256({text})) || unhex('{i:04x}'))" for i in range(STUB_DIM // 8)]
    return "[" + ", ".join(_hex_number(b, str(k)) for b in blocks for k in range(8)) + "]"


_TURNS = f"SELECT conv_id || '-' || turn AS id, conv_id::VARCHAR AS parent, turn::DOUBLE AS ci, role, {stub_sql('text')} AS v, {_tokens('text')} AS t FROM conversations"


def _branches(window: int, where: str = "true", chunks: str = _TURNS) -> str:
    terms = ("the", "and")
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    part = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))" for i in range(2))
    return f"""WITH c AS ({chunks}), vq AS (SELECT {stub_sql("'the and'")} AS v),
    knn AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT id, greatest(0, list_cosine_similarity(c.v, vq.v)) AS s FROM c, vq WHERE {where})),
    d AS (SELECT id, role, len(t) AS dl, {tf} FROM c), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM d),
    kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () AS total FROM (SELECT id, {part} AS score FROM d, st WHERE tf0 > 0 AND tf1 > 0 AND {where})),
    w AS (SELECT {window} AS w)"""


_AGG = """, doc AS (SELECT parent AS id, score, rank, ci, x.id AS chunk_id, row_number() OVER (PARTITION BY parent ORDER BY score DESC, rank, ci, x.id) AS best FROM x JOIN c ON x.id = c.id),
top AS (SELECT * FROM doc WHERE best = 1 ORDER BY score DESC, rank, ci, chunk_id LIMIT {k})
SELECT id, round(score, 9) AS score, chunk_id FROM top {where} ORDER BY top.score DESC, rank, ci, chunk_id LIMIT {limit}"""


def _mode_query(mode: Mode, **more):
    def run(spark: SparkSession, d: str) -> DataFrame:
        request = SearchRequest("the and", mode, top_k=20, **more)
        return chunk_collection(spark, d).search(request).hits.select("id", F.round("score", 9).alias("score"), "chunk_id")

    return run


_SEM = ", x AS (SELECT id, s AS score, rank FROM knn WHERE rank <= 100)"
_KW = ", x AS (SELECT id, (total - (rank - 1))::DOUBLE / total AS score, rank FROM kw WHERE rank <= 100)"
_HY = ", f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT id, rank FROM knn WHERE rank <= 100 UNION ALL SELECT id, rank FROM kw WHERE rank <= 100) GROUP BY id), x AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f)"
query("semantic_search_stub", _branches(100) + _SEM + _AGG.format(k=20, where="", limit=20))(_mode_query(Mode.SEMANTIC))
query("keyword_search", _branches(100) + _KW + _AGG.format(k=20, where="", limit=20))(_mode_query(Mode.KEYWORD))
query("hybrid_search", _branches(100) + _HY + _AGG.format(k=20, where="", limit=20))(_mode_query(Mode.HYBRID))
query("hybrid_filtered", _branches(100, "role = 'user'") + _HY + _AGG.format(k=20, where="", limit=7))(_mode_query(Mode.HYBRID, filters=Filter(must=(Match("role", "user"),)), limit=7))
query("semantic_min_score", _branches(100) + _SEM + _AGG.format(k=20, where="WHERE score >= 0.4", limit=5))(_mode_query(Mode.SEMANTIC, min_score=0.4, limit=5))


_WINDOWS = f"""SELECT 'scifact-' || doc_id || '-c' || i AS id, doc_id::VARCHAR AS parent, i::DOUBLE AS ci, NULL AS role, {stub_sql('x')} AS v, {_tokens('x')} AS t
FROM (SELECT doc_id, i, array_to_string(w[(i * 110 + 1):(i * 110 + 126)], ' ') AS x FROM (
    SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - 16) / 110.0))::INT)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0))"""


@query("hybrid_chunked_docs", _branches(100, chunks=_WINDOWS) + _HY + _AGG.format(k=20, where="", limit=20))
def hybrid_chunked_docs(spark: SparkSession, d: str) -> DataFrame:
    hits = window_collection(spark, d).search(SearchRequest("the and", Mode.HYBRID, top_k=20)).hits
    return hits.select("id", F.round("score", 9).alias("score"), "chunk_id")


@query("fluent_builder", _branches(100, "role = 'user'") + _KW + _AGG.format(k=10, where="", limit=5))
def fluent_builder(spark: SparkSession, d: str) -> DataFrame:
    hits = chunk_collection(spark, d).query("the and").mode("keyword").where("role", "user").top_k(10).limit(5).do().hits
    return hits.select("id", F.round("score", 9).alias("score"), "chunk_id")


@query("min_score_total", _branches(100) + _SEM + _AGG.format(k=20, where="WHERE score >= 0.4", limit=100).replace("SELECT id, round(score, 9) AS score, chunk_id FROM top", "SELECT count(*) AS total FROM top").split("ORDER BY top.score")[0])
def min_score_total(spark: SparkSession, d: str) -> DataFrame:
    found = chunk_collection(spark, d).search(SearchRequest("the and", Mode.SEMANTIC, top_k=20, min_score=0.4, limit=5))
    return found.before_limit.agg(F.count(F.lit(1)).alias("total"))


@query(
    "chunk_to_doc_agg",
    """WITH x AS (SELECT conv_id AS id, turn, length(text)::DOUBLE AS score, row_number() OVER (ORDER BY conv_id, turn) AS rank FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, turn) AS best FROM x)
    SELECT id::VARCHAR AS id, turn AS chunk_index, score FROM r WHERE best = 1""",
)
def chunk_to_doc_agg(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    x = t.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("parent_doc_id"), F.col("turn").cast("double").alias("chunk_index"), F.length("text").cast("double").alias("score"), F.lit(0).alias("rank"))
    return fusion.documents(x).select(F.col("doc_id").alias("id"), F.col("chunk_index").cast("long").alias("chunk_index"), "score")


# Evaluation: each vector of the query set against vectors of its own label.

_RANKED = f"""WITH q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT 'cosine' AS mode, query_id, e.vec_id AS doc_id, greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], q.v)) AS s FROM embeddings e, q),
rk AS (SELECT mode, query_id, doc_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM s),
top AS (SELECT * FROM rk WHERE rank <= 20),
rel AS (SELECT q.query_id, e.vec_id AS doc_id, 1 + (e.vec_id % 3) AS score FROM q JOIN embeddings e ON q.label = e.label),
ideal AS (SELECT query_id, sum((pow(2, score) - 1) / log2(r + 1)) FILTER (r <= 10) AS idcg, count(*) AS num_relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM rel) GROUP BY query_id),
hit AS (SELECT top.mode, top.query_id, top.rank, rel.score FROM top LEFT JOIN rel ON top.query_id = rel.query_id AND top.doc_id = rel.doc_id),
g AS (SELECT mode, query_id, coalesce(sum((pow(2, score) - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg, min(rank) FILTER (rank <= 10 AND score IS NOT NULL) AS first,
      count(*) FILTER (rank <= 10 AND score IS NOT NULL) AS hits, count(*) FILTER (score IS NOT NULL) AS deep, count(*) AS num_results FROM hit GROUP BY mode, query_id),
pq AS (SELECT mode, g.query_id, coalesce(dcg / idcg, 0) AS ndcg, coalesce(1.0::DOUBLE / first, 0) AS mrr, hits::DOUBLE / num_relevant AS recall, deep::DOUBLE / num_relevant AS recall_deep, num_results, num_relevant FROM g JOIN ideal ON g.query_id = ideal.query_id)"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    q = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", "label")
    runs = knn.knn_batch(q, df, 20).select(F.lit("cosine").alias("mode"), "query_id", F.col("id").alias("doc_id"), "rank")
    rel = q.select("query_id", "label").join(df.select(F.col("id").alias("doc_id"), "label"), "label").select("query_id", "doc_id", (F.col("doc_id") % 3 + 1).alias("score"))
    return evaluate.per_query(runs, rel)


_METRICS = ("ndcg", "mrr", "recall", "recall_deep")


@query("eval_ndcg_mrr_recall", _RANKED + f" SELECT mode, query_id, {', '.join(f'round({m}, 9) AS {m}' for m in _METRICS)}, num_results, num_relevant FROM pq")
def eval_ndcg_mrr_recall(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("mode", "query_id", *[F.round(m, 9).alias(m) for m in _METRICS], "num_results", "num_relevant")


@query("eval_summary_by_mode", _RANKED + f" SELECT mode, {', '.join(f'round(avg({m}), 9) AS mean_{m}' for m in _METRICS)}, avg(num_results) AS mean_results, count(*) AS queries FROM pq GROUP BY mode")
def eval_summary_by_mode(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.summary(_evaluated(spark, d))
    return s.select("mode", *[F.round(f"mean_{m}", 9).alias(f"mean_{m}") for m in _METRICS], "mean_results", "queries")


@query(
    "eval_best_worst",
    _RANKED
    + """, z AS (SELECT mode, query_id, round(ndcg, 9) AS n, round(mrr, 9) AS m, round(recall, 9) AS r, num_results AS k FROM pq),
    b AS (SELECT *, 'best' AS side, row_number() OVER (PARTITION BY mode ORDER BY n DESC, m DESC, r DESC, k, query_id) AS place FROM z
          UNION ALL SELECT *, 'worst', row_number() OVER (PARTITION BY mode ORDER BY n, m, r, k DESC, query_id) FROM z)
    SELECT mode, side, place, query_id, n AS ndcg FROM b WHERE place <= 5""",
)
def eval_best_worst(spark: SparkSession, d: str) -> DataFrame:
    rounded = _evaluated(spark, d).withColumns({m: F.round(m, 9) for m in _METRICS})
    return evaluate.best_and_worst(rounded).select("mode", "side", F.col("place").cast("long").alias("place"), "query_id", "ndcg")


@query("missing_judged", "SELECT l.doc_id FROM labels l ANTI JOIN (SELECT * FROM documents WHERE lang <> 'de') d ON l.doc_id = d.doc_id")
def missing_judged(spark: SparkSession, d: str) -> DataFrame:
    """Judged documents that a corpus without the German ones lacks."""
    return evaluate.missing_judged(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").where("lang <> 'de'"))


_RUNS = "SELECT p_brand AS run, round(avg(p_retailprice), 6) AS ndcg, round(avg(p_size), 6) AS recall, count(*) AS qps, round(sum(p_retailprice), 2) AS ingest_rate, round(min(p_retailprice), 6) AS elapsed FROM part GROUP BY p_brand"
_BEST = ", ".join(f"(SELECT run FROM r ORDER BY {m} {'ASC' if m == 'elapsed' else 'DESC'}, run LIMIT 1) AS best_{m}" for m in ("ndcg", "recall", "qps", "ingest_rate", "elapsed"))


@query("eval_best_runs", f"WITH r AS ({_RUNS}) SELECT {_BEST}")
def eval_best_runs(spark: SparkSession, d: str) -> DataFrame:
    """Brands of parts as runs, their figures as metrics."""
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("run"))
    runs = p.agg(
        F.round(F.avg("p_retailprice"), 6).alias("ndcg"), F.round(F.avg("p_size"), 6).alias("recall"), F.count(F.lit(1)).alias("qps"),
        F.round(F.sum("p_retailprice"), 2).alias("ingest_rate"), F.round(F.min("p_retailprice"), 6).alias("elapsed"),
    )
    return evaluate.best_runs(runs)
