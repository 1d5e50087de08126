from dataclasses import dataclass
from datetime import datetime, timedelta

import pytest

from fathom.model import Collection, CollectionExists, CollectionNotFound, Config, DocumentNotFound, EmbeddingFailed, Field, InvalidSchema, Mode, QuotaExceeded, RevisionConflict, SearchRequest, ValidationFailed, VectorDimMismatch
from fathom.operators import chunking, embedding
from fathom.operators.filters import Filter, Match, Range
from fathom.service import Engine
from fathom.sources import datasets
from fathom.sources.keyvalue import KeyValues
from fathom.sources.store import Store
from fathom.streaming import usage as streaming
from fathom.typed import Schema, TypedIndex, role

DOCS = "id string, content string, tags map<string,string>, numerics map<string,double>"


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path / "store"), buckets=4), embedding.stub(8))
    e.store.create(Collection("c", (Field("category", "tag"), Field("price", "numeric")), 8, created_at=1))
    return e


def test_collections(engine):
    s = engine.store
    with pytest.raises(CollectionExists):
        s.create(Collection("c"))
    assert s.ensure(Collection("c", (), 3)).vector_dim == 8
    s.create(Collection("d", created_at=2))
    s.create(Collection("b", created_at=3))
    assert [c.name for c in s.list()] == ["c", "d", "b"] and [c.name for c in s.list("c", 1)] == ["d"] and s.list("nope") == []
    s.drop("d")
    with pytest.raises(CollectionNotFound):
        s.get("d")


def test_documents(engine):
    assert engine.upsert("c", "1", "one", {"category": "x", "free": "y"}, {"price": 2}) is True
    assert engine.upsert("c", "1", "uno", {"category": "z"}) is False
    got = engine.get("c", "1")
    assert (got["content"], got["tags"], got["numerics"], len(got["vector"])) == ("uno", {"category": "z"}, {}, 8)
    before = got["vector"]
    assert engine.patch("c", "1", tags={"category": None, "k": "v"})["tags"] == {"k": "v"} and engine.get("c", "1")["vector"] == before
    assert engine.patch("c", "1", content="eins")["vector"] != before
    for bad in ({"tags": {"price": "1"}}, {"numerics": {"category": 1.0}}, {"numerics": {"other": 1.0}}):
        with pytest.raises(ValidationFailed):
            engine.upsert("c", "2", "text", **bad)
    with pytest.raises(ValidationFailed):
        engine.patch("c", "1")
    engine.delete("c", "1")
    for act in (lambda: engine.get("c", "1"), lambda: engine.delete("c", "1"), lambda: engine.patch("c", "1", content="x")):
        with pytest.raises(DocumentNotFound):
            act()
    engine.store.create(Collection("wide", (), 9))
    with pytest.raises(VectorDimMismatch):
        engine.upsert("wide", "1", "x")


def test_batches_and_pages(engine, spark):
    rows = [(f"d{i}", f"text number {i}", {"category": "even" if i % 2 == 0 else "odd"}, {"price": float(i)}) for i in range(23)] + [("bad/id", "x", None, None), ("e", "", None, None)]
    status = {r.id: r.error_code for r in engine.batch_upsert("c", spark.createDataFrame(rows, DOCS)).collect()}
    assert [k for k, v in status.items() if v] == ["bad/id", "e"] and engine.store.count("c") == 23
    merged = spark.createDataFrame([("d1", "changed", None, None)], DOCS)
    engine.batch_upsert("c", merged)
    assert engine.get("c", "d1")["tags"] == {"category": "odd"} and engine.get("c", "d1")["content"] == "changed"
    with pytest.raises(ValidationFailed):
        engine.batch_upsert("c", merged, limit=0)
    seen, cursor = [], None
    while True:
        page, cursor = engine.page("c", cursor, 10)
        seen += [p["id"] for p in page]
        if cursor is None:
            break
    assert seen == sorted(f"d{i}" for i in range(23))
    hits = engine.search("c", SearchRequest("text number", Mode.KEYWORD, Filter(must=(Match("category", "even"), Range("price", gt=10))), top_k=50)).hits
    assert {r.id for r in hits.collect()} == {f"d{i}" for i in range(12, 23, 2)}
    gone = engine.batch_delete("c", spark.createDataFrame([("d1",), ("zz",)], "id string"))
    assert {r.id: r.status for r in gone.collect()}["zz"] == "error" and engine.store.count("c") == 22


def test_chunked_ingest(engine, spark):
    long = " ".join(f"Sentence {i} speaks of apples and pears." for i in range(12))
    status = engine.ingest("c", spark.createDataFrame([("paper", long, None, None), ("note", "Apples.", None, None)], DOCS), window=30).collect()
    assert {r.status for r in status} == {"ok"} and engine.store.count("c") > 3
    hits = engine.search("c", SearchRequest("apples", Mode.KEYWORD)).hits.collect()
    assert sorted(h.id for h in hits) == ["note", "paper"]
    one = engine.search("c", SearchRequest("apples", Mode.KEYWORD, Filter(must=(Match("parent_doc_id", "paper"), Range("chunk_index", gte=2))))).hits.collect()
    assert len(one) == 1 and one[0].numerics["chunk_index"] >= 2


def test_a_lost_race_is_reported(engine, spark, monkeypatch):
    engine.upsert("c", "1", "one")
    write = engine.store.files.write_new
    monkeypatch.setattr(engine.store.files, "write_new", lambda path, text: False if "manifests" in path else write(path, text))
    with pytest.raises(RevisionConflict):
        engine.upsert("c", "1", "two")
    assert engine.get("c", "1")["content"] == "one"


def test_budget_and_health(engine, spark):
    ev = spark.createDataFrame([(datetime(2024, 1, 1), 100)], "ts timestamp, tokens long")
    strict = Engine(engine.store, engine.embedder, Config(daily_token_limit=100, budget_action="reject"))
    with pytest.raises(QuotaExceeded):
        strict.check_budget(ev, datetime(2024, 1, 1, 5))
    strict.check_budget(ev, datetime(2024, 1, 2, 5))
    assert engine.health()["status"] == "ok"
    broken = embedding.Embedder("x", engine.embedder.column, engine.embedder.tokens, lambda t: 1 / 0, 8)
    assert Engine(engine.store, broken).health()["status"] == "degraded"


def test_model_is_called_once_per_new_text(spark, tmp_path):
    """Results are read several times, texts repeat, and later batches know what earlier ones paid for."""
    log = str(tmp_path / "calls")

    def client():
        def call(texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return [([float(len(t)), 1.0, 0.0], 10) for t in texts]

        return call

    e = Engine(Store(spark, str(tmp_path / "store")), embedding.from_batches("m", client, 3), Config(document_instruction="doc: "), clock=lambda: datetime(2024, 5, 6, 7))
    e.create_collection(Collection("c", (), 3))
    rows = [(f"d{i}", f"text {i % 7}", None, None) for i in range(20)]
    assert {r.status for r in e.batch_upsert("c", spark.createDataFrame(rows, DOCS)).collect()} == {"ok"}
    status = e.batch_upsert("c", spark.createDataFrame([("x", "text 3", None, None), ("y", "text 9", None, None)], DOCS))
    assert status.count() == 2 and status.count() == 2
    e.upsert("c", "z", "text 9")
    with open(log) as f:
        assert sorted(f.read().split("\n")) == sorted(["", *[f"doc: text {i}" for i in range(7)], "doc: text 9"])
    used = e.usage("day")
    assert used["tokens"] == 80 and used["start"] == datetime(2024, 5, 6) and e.usage("month")["tokens"] == 80
    assert e.get("c", "x")["vector"] == e.get("c", "d3")["vector"] == [11.0, 1.0, 0.0]


def test_budgets_stop_sub_batches(spark, tmp_path, monkeypatch):
    e = Engine(Store(spark, str(tmp_path / "store")), embedding.stub(4), Config(daily_token_limit=100, budget_action="reject"), clock=lambda: datetime(2024, 1, 1))
    e.create_collection(Collection("c", (), 4))
    monkeypatch.setattr(embedding, "SUB_BATCH", 5)
    monkeypatch.setattr(embedding.admitted, "__defaults__", (5,))
    rows = [(f"d{i}", f"a text of forty characters, or so, no {i:03}", None, None) for i in range(60)]
    status = e.batch_upsert("c", spark.createDataFrame(rows, DOCS)).collect()
    stored = e.count("c")
    refused = [r for r in status if r.error_code == "embedding_quota_exceeded"]
    assert 0 < stored < 30 and stored + len(refused) == 60 and e.usage("day")["tokens"] == stored * 10
    if e.usage("day")["exhausted"]:
        with pytest.raises(QuotaExceeded):
            e.upsert("c", "new", "one more text")


def test_wrong_dimensions_are_errors_of_their_rows(spark, tmp_path):
    def client():
        return lambda texts: [([0.5] * (2 if "short" in t else 3), 1) for t in texts]

    e = Engine(Store(spark, str(tmp_path / "store")), embedding.from_batches("m", client, 3))
    e.create_collection(Collection("c", (), 3))
    status = {r.id: r.error_code for r in e.batch_upsert("c", spark.createDataFrame([("a", "fine", None, None), ("b", "short", None, None)], DOCS)).collect()}
    assert status == {"a": None, "b": "vector_dim_mismatch"} and e.count("c") == 1


def test_expected_revisions(engine):
    engine.upsert("c", "1", "one", if_revision=0)
    revision = engine.get("c", "1")["revision"]
    engine.upsert("c", "1", "two", if_revision=revision)
    with pytest.raises(RevisionConflict) as x:
        engine.upsert("c", "1", "three", if_revision=revision)
    assert x.value.current == revision + 1 and engine.get("c", "1")["content"] == "two"


def test_stored_postings_answer_as_texts_do(engine, spark):
    rows = [(f"d{i}", f"apples {'and pears ' * (i % 4)} number {i}", {"category": "even" if i % 2 == 0 else "odd"}, {"price": float(i)}) for i in range(30)]
    engine.batch_upsert("c", spark.createDataFrame(rows, DOCS))
    requests = [SearchRequest("apples pears", Mode.KEYWORD), SearchRequest("pears number", Mode.KEYWORD, Filter(must=(Match("category", "even"), Range("price", gt=4)))), SearchRequest("nowhere", Mode.KEYWORD), SearchRequest("pears", Mode.HYBRID)]
    ask = lambda: [[(r.id, round(r.score, 9)) for r in engine.search("c", q).hits.collect()] for q in requests]
    before = ask()
    engine.index("c")
    index = engine.store.keyword_index("c")
    assert ask() == before and len(before[0]) > 5 and index.n == 30
    plan = index.of_terms(["pears"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan and "content" not in plan
    engine.upsert("c", "more", "pears")
    assert engine.store.keyword_index("c") is None and len(engine.search("c", requests[3]).hits.collect()) >= len(before[3])


def test_buckets_grow_and_old_versions_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2, bucket_bytes=6000)
    store.create(Collection("c", (), 8))
    for turn in range(3):
        store.upsert("c", spark.createDataFrame([(f"d{turn}-{i}", f"text {i} " * 20, None, None) for i in range(200)], DOCS))
    _, buckets, files = store._manifest("c")
    assert buckets > 2 and store.count("c") == 600 and len(files) > 2
    assert store.get_document("c", "d1-7").count() == 1 and store.scan("c", "d2-19").count() == 11
    assert store.vacuum("c", keep=1) > 0 and store.count("c") == 600 and len(store.files.names(f"{store.root}/c/manifests")) == 1


def test_embedding_service_over_http():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    import json

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            texts = asked["input"]
            data = [{"index": i, "embedding": [float(len(t)), float(i)]} for i, t in enumerate(texts)][::-1]
            if "drop" in texts:
                data = data[1:]
            code = 500 if "fail" in texts else 200
            body = json.dumps({"data": data, "usage": {"total_tokens": 7}, "model": asked["model"], "auth": self.headers["Authorization"]}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        call = embedding.http_client(f"http://127.0.0.1:{server.server_port}/v1/", "m", "key")()
        assert call(["a", "bbb"]) == [([1.0, 0.0], 4), ([3.0, 1.0], 3)]
        for bad in (["a", "drop"], ["fail"]):
            with pytest.raises(EmbeddingFailed):
                call(bad)
        with pytest.raises(EmbeddingFailed):
            embedding.http_client("http://127.0.0.1:9/", "m", timeout=2)()(["a"])
    finally:
        server.shutdown()


def test_local_model_pools_token_vectors(spark):
    def load():
        return lambda texts: ([[[1.0, 0.0], [3.0, 4.0], [9.0, 9.0]] for _ in texts], [[1, 1, 0] for _ in texts])

    e = embedding.local_model("m", load, 2)
    out, _ = embedding.embed(spark.createDataFrame([("1", "abc")], "id string, content string"), e)
    r = out.first()
    assert r.vector == pytest.approx([2 / 8**0.5, 2 / 8**0.5]) and r.total_tokens == 2


def test_chunker_plug_in(engine, spark):
    def halves(text):
        if "!" in text:
            raise ValueError("no marks")
        w = text.split()
        return [(" ".join(w[: len(w) // 2]), len(w) // 2), (" ".join(w[len(w) // 2 :]), len(w) - len(w) // 2)]

    docs = spark.createDataFrame([("p", "one two three four", None, None), ("q", "bad!", None, None)], DOCS)
    status = {r.id: (r.status, r.error) for r in engine.ingest("c", docs, chunker=chunking.chunker_of(halves)).collect()}
    assert status == {"p-chunk-0001": ("ok", None), "p-chunk-0002": ("ok", None), "q": ("error", "no marks")}
    assert engine.get("c", "p-chunk-0002")["content"] == "three four"


def test_key_values(spark, tmp_path):
    kv = KeyValues(spark, str(tmp_path / "kv"))
    t = datetime(2024, 1, 1)
    assert kv.get("a", t) is None
    kv.set("a", "x", timedelta(hours=2), t)
    assert kv.get("a", t + timedelta(hours=1)) == "x" and kv.get("a", t + timedelta(hours=2)) is None
    assert kv.incr("n", 3, t) == 3 and kv.incr("n", 4, t + timedelta(hours=1)) == 7
    kv.expire_if_unset("n", timedelta(hours=5), t + timedelta(hours=2))
    kv.expire_if_unset("n", timedelta(hours=50), t + timedelta(hours=3))
    assert kv.get("n", t + timedelta(hours=6)) == "7" and kv.get("n", t + timedelta(hours=8)) is None
    assert kv.incr("n", 1, t + timedelta(hours=9)) == 1  # what has expired starts anew
    kv.compact(t + timedelta(hours=10))
    assert {r.key: r.value for r in kv.all(t + timedelta(hours=11)).collect()} == {"n": "1"}


@dataclass
class Place:
    key: str = role("id")
    about: str = role("content")
    town: str = role("tag", "locality")
    stars: float = role("numeric")
    note: str = role("stored", default="")


def test_typed_index(engine):
    t = TypedIndex(engine, "places", Place)
    assert [(f.name, f.kind) for f in t.ensure().fields] == [("locality", "tag"), ("stars", "numeric")]
    t.upsert(Place("p1", "a harbour with boats", "Paphos", 4.5, "n"))
    t.upsert_batch([Place("p2", "a castle", "Paphos", 3), Place("p3", "a beach with boats", "Polis", 5)])
    assert t.get("p1") == Place("p1", "a harbour with boats", "Paphos", 4.5, "n") and t.count() == 3
    found = t.hits(t.search("boats").mode("keyword").where("locality", "Polis").limit(3))
    assert [p.key for p, _ in found] == ["p3"]
    t.delete("p1")
    assert t.count() == 2

    @dataclass
    class NoId:
        x: str = role("content")

    with pytest.raises(InvalidSchema):
        Schema(NoId)


def test_stream_and_bulk_load(engine, spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("1", "one", None, None), ("2", "two", None, None)], DOCS).write.parquet(src)
    stream = spark.readStream.schema(DOCS).parquet(src)
    for turn in range(2):  # the second one has lost its checkpoint: the same rows again change nothing
        streaming.bulk_load(stream, lambda df: engine.batch_upsert("c", df), str(tmp_path / f"cp{turn}")).awaitTermination()
    assert engine.store.count("c") == 2
    ev = str(tmp_path / "ev")
    spark.createDataFrame([(datetime(2024, 1, d, 3), 10) for d in (1, 1, 2, 31)], "ts timestamp, tokens long").write.parquet(ev)
    days = streaming.daily_counters(spark.readStream.schema("ts timestamp, tokens long").parquet(ev))
    streaming.run_to_table(days, str(tmp_path / "cpd"), str(tmp_path / "days")).awaitTermination()
    out = {r.period_start.day: r.tokens for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    assert out == {1: 20, 2: 10}  # the last day is still open
    assert streaming.monthly_from_daily(spark.read.parquet(str(tmp_path / "days"))).first().tokens == 30


def test_datasets_and_reports(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "title": "T", "text": "x"}\n{"_id": "2", "title": "", "text": "y"}\n')
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\nq\t2\t0\n")
    assert {r.doc_id: r.content for r in datasets.corpus(spark, str(tmp_path / "corpus.jsonl")).collect()} == {"1": "T\n\nx", "2": "y"}
    assert datasets.qrels(spark, str(tmp_path / "qrels.tsv")).count() == 1
    s = spark.createDataFrame([("m", 0.5)], "mode string, mean_ndcg double")
    datasets.write_reports(s, s, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/summary")).count() == 1 and "| m | 0.5000 |" in datasets.markdown(s)
