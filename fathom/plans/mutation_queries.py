"""Reading by key, paging and writing, as queries over the structured tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.model import Collection, Field
from fathom.operators import embedding, filters, mutations
from fathom.operators.filters import Filter, Match, Range
from fathom.plans.registry import query, table
from fathom.service import Engine
from fathom.sources import scratch
from fathom.sources.store import Store
from fathom.streaming import usage as streaming


@query("point_get", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return mutations.point_get(table(spark, d, "customer"), 42, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("multi_get", "SELECT k.pos, k.id AS c_custkey, c.c_name FROM (VALUES (0, 7::BIGINT), (1, 3::BIGINT), (2, 999999999::BIGINT), (3, 7::BIGINT)) AS k(pos, id) LEFT JOIN customer c ON c.c_custkey = k.id")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    return mutations.multi_get(table(spark, d, "customer"), [7, 3, 999999999, 7], "c_custkey").select("pos", "c_custkey", "c_name")


@query("exists_many", "SELECT c_custkey FROM (SELECT DISTINCT o_custkey + 500 AS c_custkey FROM orders) o WHERE c_custkey IN (SELECT c_custkey FROM customer)")
def exists_many(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "orders").select((F.col("o_custkey") + 500).alias("c_custkey")).distinct()
    return mutations.exists(table(spark, d, "customer"), asked, "c_custkey")


@query("list_page_offset", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey OFFSET 100 LIMIT 21")
def list_page_offset(spark: SparkSession, d: str) -> DataFrame:
    return mutations.page_offset(table(spark, d, "orders"), 100, 21, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("list_page_keyset", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 21")
def list_page_keyset(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = mutations.page(table(spark, d, "orders"), 100, 21, "o_orderkey")
    return rows.select("o_orderkey", "o_orderstatus")


@query("prefix_scan", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000010')")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return mutations.prefix_scan(table(spark, d, "customer"), "Customer#00000010", "c_name").select("c_custkey", "c_name")


@query("query_list", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 30 ORDER BY p_partkey OFFSET 40 LIMIT 25")
def query_list(spark: SparkSession, d: str) -> DataFrame:
    """A filter and a page in one query."""
    part = table(spark, d, "part")
    spec = Filter(must=(Range("p_size", gte=10, lt=30),))
    return mutations.query_list(part, filters.predicate(part, spec), 40, 25, "p_partkey").select("p_partkey", "p_size")


@query("collections_page", "SELECT 'c' || n_nationkey AS name, n_nationkey::BIGINT AS created_at FROM nation WHERE n_nationkey > 9 ORDER BY n_nationkey LIMIT 5")
def collections_page(spark: SparkSession, d: str) -> DataFrame:
    """A collection for each nation; the page behind c9."""
    store = Store(spark, scratch.new_folder(spark, "catalog"))
    for r in table(spark, d, "nation").select("n_nationkey").collect():
        store.create(Collection(f"c{r.n_nationkey}", (), 8, created_at=r.n_nationkey + 1))
    return spark.createDataFrame([(c.name, c.created_at - 1) for c in store.list("c9", 5)], "name string, created_at long")


@query("collection_metadata", "SELECT n_name AS name, 'text' AS type, 'region:tag,size:numeric' AS fields, 8 + n_nationkey AS vector_dim, 1 AS revision FROM nation WHERE NOT contains(n_name, ' ')")
def collection_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A collection for each nation with a name of one word: created, and read back from its stored description."""
    store, made = Store(spark, scratch.new_folder(spark, "catalog")), []
    for r in table(spark, d, "nation").select("n_nationkey", "n_name").where("not contains(n_name, ' ')").collect():
        store.ensure(Collection(r.n_name, (Field("region", "tag"), Field("size", "numeric")), 8 + r.n_nationkey))
        c = store.get(r.n_name)
        made.append((c.name, c.type, ",".join(f"{f.name}:{f.kind}" for f in c.fields), c.vector_dim, c.revision))
    return spark.createDataFrame(made, "name string, type string, fields string, vector_dim int, revision int")


@query("count_filtered", "SELECT count(*) AS n FROM part WHERE p_size >= 10 AND p_size < 30 AND (p_brand = 'Brand#1' OR p_retailprice > 1000) AND NOT p_type = 'x'")
def count_filtered(spark: SparkSession, d: str) -> DataFrame:
    spec = Filter.parse({
        "must": [{"key": "p_size", "range": {"gte": 10, "lt": 30}}],
        "should": [{"key": "p_brand", "match": "Brand#1"}, {"key": "p_retailprice", "range": {"gt": 1000}}],
        "must_not": [{"key": "p_type", "match": "x"}],
    })
    return filters.apply(table(spark, d, "part"), spec).agg(F.count(F.lit(1)).alias("n"))


@query("map_filtered", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000 AND NOT c_nationkey < 5")
def map_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Filters on map entries instead of columns."""
    c = table(spark, d, "customer").select("c_custkey", F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("tags"), F.create_map(F.lit("balance"), F.col("c_acctbal"), F.lit("nation"), F.col("c_nationkey").cast("double")).alias("numerics"))
    spec = Filter(must=(Match("segment", "BUILDING"), Range("balance", gt=1000)), must_not=(Range("nation", lt=5), Match("absent", "x")))
    return filters.apply(c, spec).select("c_custkey")


def _old(spark: SparkSession, d: str) -> DataFrame:
    """customer as documents."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("content"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("kept"), F.lit("old")).alias("tags"),
        F.create_map(F.lit("balance"), F.col("c_acctbal")).alias("numerics"), F.lit(None).cast("array<float>").alias("vector"), F.lit(1).alias("revision"),
    )


def _new(spark: SparkSession, d: str) -> DataFrame:
    """supplier as documents whose ids overlap the customers'."""
    s = table(spark, d, "supplier")
    return s.select(
        (F.col("s_suppkey") + 20).cast("string").alias("id"), F.col("s_name").alias("content"), F.create_map(F.lit("segment"), F.lit("SUPPLIER")).alias("tags"),
        F.create_map(F.lit("nation"), F.col("s_nationkey").cast("double")).alias("numerics"), F.lit(None).cast("array<float>").alias("vector"), F.lit(1).alias("revision"),
    )


def _flat(df: DataFrame) -> DataFrame:
    t, n = F.col("tags"), F.col("numerics")
    return df.select("id", "content", t["segment"].alias("segment"), t["kept"].alias("kept"), F.round(n["balance"], 6).alias("balance"), n["nation"].alias("nation"))


_OLD = "o AS (SELECT c_custkey::VARCHAR AS id, c_name AS content, c_mktsegment AS segment, 'old' AS kept, round(c_acctbal, 6) AS balance, NULL::DOUBLE AS nation FROM customer)"
_NEW = "n AS (SELECT (s_suppkey + 20)::VARCHAR AS id, s_name AS content, 'SUPPLIER' AS segment, NULL::VARCHAR AS kept, NULL::DOUBLE AS balance, s_nationkey::DOUBLE AS nation FROM supplier)"


@query("upsert_replace", f"WITH {_OLD}, {_NEW} SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    return _flat(mutations.upsert_replace(_old(spark, d), _new(spark, d)))


@query("bulk_upsert_merge", f"WITH {_OLD}, {_NEW} SELECT id, coalesce(n.content, o.content) AS content, coalesce(n.segment, o.segment) AS segment, coalesce(n.kept, o.kept) AS kept, coalesce(n.balance, o.balance) AS balance, coalesce(n.nation, o.nation) AS nation FROM o FULL JOIN n USING (id)")
def bulk_upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    return _flat(mutations.upsert_merge(_old(spark, d), _new(spark, d)))


@query("stream_upsert", f"WITH {_OLD}, {_NEW} SELECT id, coalesce(n.content, o.content) AS content, coalesce(n.segment, o.segment) AS segment, coalesce(n.kept, o.kept) AS kept, coalesce(n.balance, o.balance) AS balance, coalesce(n.nation, o.nation) AS nation FROM o FULL JOIN n USING (id)")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Customers in a stored collection; suppliers arrive as a stream and are merged by id, and once more after the stream has lost its place."""
    place = scratch.new_folder(spark, "stream-upsert")
    store = Store(spark, f"{place}/store")
    store.create(Collection("c", (), 8))
    store.upsert("c", _old(spark, d))
    _new(spark, d).write.parquet(f"{place}/in")
    arriving = spark.readStream.schema(spark.read.parquet(f"{place}/in").schema).parquet(f"{place}/in")
    for turn in range(2):
        streaming.bulk_load(arriving, lambda df: store.upsert("c", df, "merge"), f"{place}/checkpoint-{turn}").awaitTermination()
    return _flat(store.read("c"))


@query("upsert_created", f"WITH {_OLD}, {_NEW} SELECT id, id NOT IN (SELECT id FROM o) AS created FROM n")
def upsert_created(spark: SparkSession, d: str) -> DataFrame:
    return mutations.created(_old(spark, d), _new(spark, d))


def _patches(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    odd = F.col("s_suppkey") % 2 == 1
    return s.select(
        F.col("s_suppkey").cast("string").alias("id"), F.when(odd, F.col("s_name")).alias("content"),
        F.create_map(F.lit("kept"), F.when(odd, F.lit("new"))).alias("tags"), F.when(odd, F.create_map(F.lit("balance"), F.lit(None).cast("double"), F.lit("nation"), F.lit(1.0))).alias("numerics"),
    )


@query("patch_merge", f"""WITH {_OLD}, p AS (SELECT s_suppkey::VARCHAR AS pid, s_suppkey % 2 = 1 AS odd, s_name FROM supplier)
SELECT id, CASE WHEN odd THEN s_name ELSE content END AS content, segment, CASE WHEN odd THEN 'new' WHEN pid IS NOT NULL THEN NULL ELSE kept END AS kept,
CASE WHEN odd THEN NULL ELSE balance END AS balance, CASE WHEN odd THEN 1.0::DOUBLE END AS nation FROM o LEFT JOIN p ON o.id = p.pid""")
def patch_merge(spark: SparkSession, d: str) -> DataFrame:
    return _flat(mutations.patch(_old(spark, d), _patches(spark, d)))


@query("batch_delete_status", f"WITH {_OLD}, ids AS (SELECT (s_suppkey * 40)::VARCHAR AS id FROM supplier) SELECT id, CASE WHEN id IN (SELECT id FROM o) THEN 'ok' ELSE 'error' END AS status, CASE WHEN id NOT IN (SELECT id FROM o) THEN 'document_not_found' END AS error_code FROM ids")
def batch_delete_status(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "supplier").select((F.col("s_suppkey") * 40).cast("string").alias("id"))
    return mutations.delete_status(_old(spark, d), ids).select("id", "status", "error_code")


@query("batch_delete", f"WITH {_OLD} SELECT * FROM o WHERE id NOT IN (SELECT (s_suppkey * 40)::VARCHAR FROM supplier)")
def batch_delete(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "supplier").select((F.col("s_suppkey") * 40).cast("string").alias("id"))
    return _flat(mutations.delete(_old(spark, d), ids))


_PAGES = Collection("pages", (Field("price", "numeric"), Field("lang", "tag")))


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    return p.select(
        F.when(key % 7 == 0, F.concat(key.cast("string"), F.lit("/x"))).otherwise(key.cast("string")).alias("id"), F.when(key % 5 != 0, F.col("p_name")).otherwise("").alias("content"),
        F.create_map(F.when(key % 3 == 0, "price").otherwise("colour"), F.lit("a")).alias("tags"), F.create_map(F.when(key % 11 == 0, "weight").otherwise("price"), F.lit(1.0)).alias("numerics"),
    )


_DRAFT_SQL = """WITH s AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN p_partkey || '/x' ELSE p_partkey::VARCHAR END AS id,
CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN 'validation_failed' WHEN p_partkey % 3 = 0 OR p_partkey % 11 = 0 THEN 'invalid_schema' END AS error_code FROM part)"""


@query("batch_validate_status", _DRAFT_SQL + " SELECT id, CASE WHEN error_code IS NULL THEN 'ok' ELSE 'error' END AS status, error_code FROM s")
def batch_validate_status(spark: SparkSession, d: str) -> DataFrame:
    return mutations.validate(_drafts(spark, d), _PAGES)[1].select("id", "status", "error_code")


@query("batch_summary", _DRAFT_SQL + " SELECT count(*) FILTER (error_code IS NULL) AS succeeded, count(*) FILTER (error_code IS NOT NULL) AS failed FROM s")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return mutations.summary(mutations.validate(_drafts(spark, d), _PAGES)[1])


def _engine(spark: SparkSession, label: str) -> Engine:
    engine = Engine(Store(spark, f"{scratch.new_folder(spark, label)}/store"), embedding.stub(8), clock=lambda: datetime(2024, 1, 17, 12))
    engine.create_collection(Collection("parts", _PAGES.fields, 8))
    return engine


@query("engine_batch", _DRAFT_SQL + " SELECT id, CASE WHEN error_code IS NULL THEN 'ok' ELSE 'error' END AS status, error_code FROM s")
def engine_batch(spark: SparkSession, d: str) -> DataFrame:
    """The same batch through the whole service: validated, embedded, stored."""
    return _engine(spark, "engine-batch").batch_upsert("parts", _drafts(spark, d)).select("id", "status", "error_code")


_SOUND = "p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 11 <> 0"


@query("engine_usage", f"SELECT 'day' AS period, sum(floor(length(p_name) / 4))::BIGINT AS tokens, (SELECT count(*) FROM part WHERE {_SOUND}) AS documents FROM (SELECT DISTINCT p_name FROM part WHERE {_SOUND})")
def engine_usage(spark: SparkSession, d: str) -> DataFrame:
    """Tokens counted after a batch was stored twice: each text is paid for once."""
    engine = _engine(spark, "engine-usage")
    for _ in range(2):
        engine.batch_upsert("parts", _drafts(spark, d))
    return spark.createDataFrame([("day", engine.usage("day")["tokens"], engine.count("parts"))], "period string, tokens long, documents long")
