"""Chunking, sentence and embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text, vectors
from fathom.functions.embedding import stub_vector
from fathom.operators import chunking, embedding, evaluate
from fathom.plans.registry import query, table
from fathom.plans.search_queries import STUB_DIM, stub_sql
from fathom.sources import datasets, scratch

#: Unicode white space, which DuckDB's \\s does not know.
_WHITE = r"[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]"
_SENTENCES = (
    r"""list_filter(list_transform(string_split_regex(regexp_replace({}, '([.!?]["''\)\]}}]*)("""
    + _WHITE
    + r""")', '\1' || chr(1) || '\2', 'g'), chr(1) || '|\n\n'), lambda x: trim(regexp_replace(x, '"""
    + _WHITE
    + r"""+', ' ', 'g'))), lambda x: x <> '')"""
)


@query("sentence_split", f"WITH s AS (SELECT doc_id, unnest({_SENTENCES.format('text')}) AS sentence, generate_subscripts({_SENTENCES.format('text')}, 1) - 1 AS n FROM documents) SELECT doc_id, n, sentence FROM s")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence")).withColumn("n", F.col("n").cast("long"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.create_map(F.lit("lang"), F.col("lang")).alias("tags"), F.lit(None).cast("map<string,double>").alias("numerics"))


_FIXED = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - 16) / 110.0))::INT)) AS i FROM w WHERE len(w) > 0),
f AS (SELECT doc_id, i, w[(i * 110 + 1):(i * 110 + 126)] AS p FROM c)"""


@query("fixed_window_chunks", _FIXED + " SELECT 'scifact-' || doc_id || '-c' || i AS chunk_id, doc_id AS source_doc_id, i AS chunk_idx, md5(array_to_string(p, ' ')) AS content_md5, len(p) + 2 AS token_count FROM f")
def fixed_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    size, overlap = chunking.PRESETS["A"]
    c = chunking.fixed_windows(table(spark, d, "documents"), size, overlap, "doc_id", "text")
    return c.select("chunk_id", "source_doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.md5("content").alias("content_md5"), F.col("token_count").cast("long").alias("token_count"))


@query("corpus_stats", _FIXED + ", z AS (SELECT doc_id, count(*) AS n, sum(len(p) + 2) AS t, min(len(p) + 2) AS lo, max(len(p) + 2) AS hi FROM f GROUP BY doc_id) SELECT count(*) AS documents, sum(n)::BIGINT AS chunks, round((sum(t) / sum(n))::DOUBLE, 6) AS avg_tokens, min(lo) AS min_tokens, max(hi) AS max_tokens, round(avg(n), 6) AS avg_chunks, min(n) AS min_chunks, max(n) AS max_chunks FROM z")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.corpus_stats(chunking.fixed_windows(table(spark, d, "documents"), 128, 16, "doc_id", "text"))
    return s.withColumns({"avg_tokens": F.round("avg_tokens", 6), "avg_chunks": F.round("avg_chunks", 6), "min_tokens": F.col("min_tokens").cast("long"), "max_tokens": F.col("max_tokens").cast("long")})


#: Sums of the sentences' tokens up to each place; a window takes sentences while they fit, and the next one starts far enough back.
_GREEDY = rf"""WITH RECURSIVE s AS (SELECT doc_id::VARCHAR AS id, text, {_SENTENCES.format('text')} AS s FROM documents),
n AS (SELECT id, text, s, list_transform(s, lambda x: len(regexp_extract_all(x, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) + 2) AS n FROM s),
p AS (SELECT id, text, s, len(s) AS len, coalesce(list_max(n), 0) > 256 AS bad, list_prepend(0, list_transform(n, lambda x, i: list_sum(n[1:i])))::BIGINT[] AS p FROM n),
w AS (
    SELECT id, 0::BIGINT AS first, (len(list_filter(p, lambda x: x <= 256)) - 1)::BIGINT AS past, 1 AS k FROM p WHERE NOT bad AND len > 0
    UNION ALL
    SELECT id, first, (len(list_filter(p, lambda x: x <= p[first + 1] + 256)) - 1)::BIGINT AS past, k FROM (
        SELECT w.id, p.p, w.k + 1 AS k, greatest(w.first + 1, len(list_filter(p.p, lambda x: x <= p.p[w.past + 1] - 26)) - 1)::BIGINT AS first FROM w JOIN p ON w.id = p.id WHERE w.past < p.len)
),
c AS (SELECT id, max(k) AS chunks FROM w GROUP BY id)
SELECT CASE WHEN c.chunks > 1 THEN p.id || '-chunk-' || lpad(w.k::VARCHAR, greatest(4, length(w.k::VARCHAR))::INT, '0') ELSE p.id END AS id,
       CASE WHEN NOT bad THEN md5(CASE WHEN c.chunks > 1 THEN array_to_string(s[w.first + 1 : w.past], ' ') ELSE text END) END AS content_md5,
       CASE WHEN c.chunks > 1 THEN (p.p[w.past + 1] - p.p[w.first + 1])::INT END AS tokens, p.id AS parent_doc_id,
       CASE WHEN NOT bad THEN coalesce(w.k, 1)::DOUBLE END AS chunk_index, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status
FROM p LEFT JOIN w ON p.id = w.id LEFT JOIN c ON p.id = c.id"""


@query("sentence_window_chunks", _GREEDY)
def sentence_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, and a row of status `error` for each document with a sentence over the window."""
    cut = chunking.window_chunks(_docs(spark, d))
    chunked = chunking.chunk_documents(cut.where("error is null"))
    good = chunked.select("id", F.md5("content").alias("content_md5"), "tokens", F.col("tags")["parent_doc_id"].alias("parent_doc_id"), F.col("numerics")["chunk_index"].alias("chunk_index"), F.lit("ok").alias("status"))
    none = F.lit(None)
    bad = cut.where("error is not null").select("id", none.cast("string").alias("content_md5"), none.cast("int").alias("tokens"), F.col("id").alias("parent_doc_id"), none.cast("double").alias("chunk_index"), F.lit("error").alias("status"))
    return good.unionByName(bad)


@query("chunk_documents_ids", f"""WITH s AS (SELECT doc_id::VARCHAR AS id, {_SENTENCES.format('text')} AS s, text FROM documents), e AS (SELECT id, s, text, unnest(range(1, greatest(len(s), 1) + 1)) AS i FROM s)
SELECT CASE WHEN len(s) > 1 THEN id || '-chunk-' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INT, '0') ELSE id END AS id, id AS parent_doc_id, i::DOUBLE AS chunk_index, md5(CASE WHEN len(s) > 1 THEN s[i] ELSE text END) AS content_md5 FROM e""")
def chunk_documents_ids(spark: SparkSession, d: str) -> DataFrame:
    """A chunk for each sentence."""
    one = F.transform(text.sentences(F.col("content")), lambda s: F.struct(s.alias("content"), F.lit(None).cast("int").alias("tokens")))
    c = chunking.chunk_documents(_docs(spark, d).withColumn("chunks", one))
    return c.select("id", F.col("tags")["parent_doc_id"].alias("parent_doc_id"), F.col("numerics")["chunk_index"].alias("chunk_index"), F.md5("content").alias("content_md5"))


def _components(v: DataFrame, key: str) -> DataFrame:
    return v.select(key, F.posexplode("v").alias("i", "x")).select(key, F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def _components_sql(source: str, key: str, length: int) -> str:
    """Components of v, each divided by the length of v."""
    return f"WITH v AS ({source}) SELECT {key}, i, round(v[i + 1] / sqrt(list_dot_product(v, v)), 6) AS x FROM v, range({length}) r(i)"


@query("stub_embed", _components_sql(f"SELECT doc_id, {stub_sql('text')} AS v FROM documents", "doc_id", STUB_DIM))
def stub_embed(spark: SparkSession, d: str) -> DataFrame:
    return _components(table(spark, d, "documents").select("doc_id", stub_vector(F.col("text"), STUB_DIM).alias("v")), "doc_id")


@query("instructed_embed", _components_sql(f"SELECT item_id, {stub_sql(chr(39) + 'query: ' + chr(39) + ' || text')} AS v FROM benchmark", "item_id", STUB_DIM).replace("round(v[i + 1] / sqrt(list_dot_product(v, v)), 6)", "round((v[i + 1] / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE, 6)"))
def instructed_embed(spark: SparkSession, d: str) -> DataFrame:
    """An instruction stands before every text."""
    e = embedding.instructed(embedding.stub(STUB_DIM), "query: ")
    out, _ = embedding.embed(table(spark, d, "benchmark"), e, "text")
    return _components(out.select("item_id", F.transform("vector", lambda x: x.cast("double")).alias("v")), "item_id")


@query("l2_normalize", _components_sql("SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3 + 0.1::DOUBLE) AS v FROM embeddings", "vec_id", 64))
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3 + F.lit(0.1)).alias("v"))
    return _components(v.select("vec_id", vectors.l2_normalize(F.col("v")).alias("v")), "vec_id")


_POOLED = "SELECT vec_id, list_transform(range(1, 9), lambda k: (embedding[k]::DOUBLE + embedding[k + 16] + embedding[k + 32] + embedding[k + 48]) / 4) AS v FROM embeddings"


@query("mean_pooling", _components_sql(_POOLED, "vec_id", 8))
def mean_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as eight token vectors of eight components, of which the mask keeps every other."""
    places = F.sequence(F.lit(0), F.lit(7))
    tokens = F.transform(places, lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    v = table(spark, d, "embeddings").select("vec_id", vectors.mean_pool(tokens, F.transform(places, lambda k: 1 - k % 2)).alias("v"))
    return _components(v, "vec_id")


@query("vector_bytes", "SELECT vec_id, 256 AS bytes, i, round(embedding[i + 1]::DOUBLE, 6) AS x FROM embeddings, range(64) r(i)")
def vector_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors to little-endian bytes and back."""
    packed = table(spark, d, "embeddings").select("vec_id", vectors.pack("embedding").alias("b"))
    back = packed.select("vec_id", F.octet_length("b").alias("bytes"), F.posexplode(vectors.unpack("b")).alias("i", "x"))
    return back.select("vec_id", "bytes", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("title_and_text", """SELECT c_custkey, concat_ws(chr(10) || chr(10), nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE ' ' || c_name END), ''),
CASE WHEN c_custkey % 5 <> 0 THEN nullif(trim(c_mktsegment), '') END) AS content FROM customer""")
def title_and_text(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    title = F.when(key % 3 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("c_name")))
    return table(spark, d, "customer").select("c_custkey", text.title_and_text(title, F.when(key % 5 != 0, F.col("c_mktsegment"))).alias("content"))


@query("numeric_id_order", """WITH x AS (SELECT p_brand, CASE WHEN p_partkey % 7 = 0 THEN 'x' || p_partkey ELSE p_partkey::VARCHAR END AS id FROM part)
SELECT p_brand, id, row_number() OVER (PARTITION BY p_brand ORDER BY TRY_CAST(id AS BIGINT) IS NULL, TRY_CAST(id AS BIGINT) NULLS FIRST, id) AS place FROM x""")
def numeric_id_order(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are numbers in their order, before the others, within each brand."""
    key = F.col("p_partkey").cast("string")
    ids = table(spark, d, "part").select("p_brand", F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("id"))
    return ids.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(*text.numeric_order(F.col("id")))).cast("long"))


@query("dataset_queries", "SELECT item_id::VARCHAR AS query_id, md5(text) AS text_md5 FROM benchmark")
def dataset_queries(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark as a data set's JSON lines, written and loaded again."""
    path = scratch.new_folder(spark, "dataset") + "/queries.jsonl"
    table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text").write.json(path)
    return datasets.queries(spark, path).select("query_id", F.md5("text").alias("text_md5"))


@query(
    "embedding_cache_partition",
    "WITH t AS (SELECT DISTINCT text FROM documents), c AS (SELECT DISTINCT text FROM documents WHERE lang = 'en') SELECT sha256(text) AS key, text IN (SELECT text FROM c) AS hit FROM t",
)
def embedding_cache_partition(spark: SparkSession, d: str) -> DataFrame:
    """The cache holds the texts of English documents."""
    docs = table(spark, d, "documents")
    cache = docs.where("lang = 'en'").select(F.lit("stub").alias("model"), F.sha2("text", 256).alias("key"), F.array(F.lit(0.0)).cast("array<float>").alias("embedding")).distinct()
    hits, misses = embedding.split_by_cache(docs, cache, "stub")
    return hits.select("key", F.lit(True).alias("hit")).unionByName(misses.select("key", F.lit(False).alias("hit")))


@query("embedding_tokens", "SELECT count(*) AS texts, sum(floor(length(text) / 4))::BIGINT AS tokens FROM (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en'))")
def embedding_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that embedding all documents costs if the English ones are cached."""
    docs = table(spark, d, "documents")
    cache = docs.where("lang = 'en'").select(F.lit("stub").alias("model"), F.sha2("text", 256).alias("key"), F.array(F.lit(0.0)).cast("array<float>").alias("embedding")).distinct()
    _, misses = embedding.split_by_cache(docs, cache, "stub")
    return misses.agg(F.count(F.lit(1)).alias("texts"), F.sum(embedding.stub(STUB_DIM).tokens(F.col("text"))).alias("tokens"))
