import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import embedding as stub_functions
from fathom.functions import text, vectors
from fathom.model import Collection, DocumentNotFound, Field, Mode, SearchRequest, SimilarRequest
from fathom.operators import bm25, chunking, embedding, evaluate, filters, fusion, knn, mutations, usage
from fathom.operators.filters import Filter, Match, Range
from fathom.operators.search import Searcher

# Five documents in the manner of the usual end-to-end fixture.
DOCS = [
    ("doc-1", "Python is a language for scripts and web development", "programming", 10.0),
    ("doc-2", "Go is a language with static typing", "programming", 8.0),
    ("doc-3", "Clusters of containers need orchestration", "infrastructure", 9.0),
    ("doc-4", "A store that keeps data in memory", "database", 7.0),
    ("doc-5", "Containers hold an application and its libraries", "infrastructure", 6.0),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, c, {"category": t}, {"priority": n}, stub_functions.stub_vector_of(c, 8)) for i, c, t, n in DOCS]
    rows.append(("doc-6", "Nothing is known about this language", {}, {}, None))
    return spark.createDataFrame(rows, "id string, content string, tags map<string,string>, numerics map<string,double>, vector array<float>").cache()


@pytest.fixture(scope="module")
def searcher(docs):
    return Searcher(docs, Collection("c", (Field("category", "tag"), Field("priority", "numeric")), 8), lambda q: stub_functions.stub_vector_of(q, 8))


def ids(df, col="id"):
    return [r[col] for r in df.collect()]


def test_filter_truth_table(docs):
    got = lambda **g: set(ids(filters.apply(docs, Filter(**g))))
    assert got() == {f"doc-{i}" for i in range(1, 7)}
    assert got(must=(Match("category", "programming"),)) == {"doc-1", "doc-2"}
    assert got(must=(Match("category", "programming"), Range("priority", gt=8))) == {"doc-1"}
    assert got(must=(Range("priority", gte=8),), should=(Match("category", "infrastructure"), Match("category", "database"))) == {"doc-3"}
    assert got(should=(Range("priority", lt=7), Match("category", "database"))) == {"doc-4", "doc-5"}
    assert got(must_not=(Match("category", "programming"), Range("priority", lte=6))) == {"doc-3", "doc-4", "doc-6"}
    assert got(must_not=(Match("absent", "x"),)) == {f"doc-{i}" for i in range(1, 7)}


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    row = df.select(
        vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), [-3.0, -4.0]), vectors.l2_distance(F.col("a"), F.col("b")), vectors.inner_product(F.col("a"), [1.0, 2.0]),
        vectors.l2_normalize(F.col("a")), vectors.l2_normalize(vectors.constant([0.0, 0.0])), vectors.cosine(F.col("a"), [1.0, 2.0, 3.0]), vectors.cosine(F.col("a"), [0.0, 0.0]),
        vectors.unpack(vectors.pack("a")), vectors.unpack(F.lit(bytearray(b"abc"))),
        vectors.mean_pool(F.expr("array(array(1D, 0D), array(0D, 1D), array(9D, 9D))"), F.expr("array(1, 1, 0)")),
    ).first()
    assert row[0] == pytest.approx(0.96) and row[1] == 0 and row[2] == pytest.approx(math.sqrt(2)) and row[3] == 11
    assert row[4] == pytest.approx([0.6, 0.8]) and row[5] == [0, 0] and row[6] is None and row[7] is None and row[8] == [3, 4] and row[9] is None
    assert row[10] == pytest.approx([math.sqrt(0.5)] * 2)


def test_stub_agrees_with_its_driver_form(spark):
    texts = ["", "a", "Grüße 漢字", "x" * 5000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(stub_functions.stub_vector(F.col("t"), 20).alias("v")).collect()
    for t, r in zip(texts, got, strict=True):
        assert r["v"] == pytest.approx(stub_functions.stub_vector_of(t, 20), abs=1e-12)


def test_knn_batch_is_exact_with_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x[50:60] = x[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6)], "id long, vector array<float>")
    q = df.where("id < 45").select(F.col("id").alias("query_id"), "vector")
    got = {(r.query_id, r["rank"]): r.id for r in knn.knn_batch(q, df, 7, query_bytes=10 * 8 * 8).collect()}
    f = x.astype("f4").astype("f8")
    u = f / np.linalg.norm(f, axis=1)[:, None]
    for i in range(45):
        s = np.round(np.maximum(0, u @ u[i]), 9)
        want = sorted(range(300), key=lambda j: (-s[j], j))[:7]
        assert [got[i, r] for r in range(1, 8)] == want


def test_knn_batch_with_vectors_of_other_lengths(spark):
    rows = [(i, [1.0, float(i)]) for i in range(5)] + [(10 + i, [1.0, 0.0, float(i)]) for i in range(4)] + [(90, []), (91, None), (92, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    near = knn.similar_pairs(df, 3).collect()
    kind = lambda i: "two" if i < 10 else "three"
    assert {r.query_id for r in near} == {*range(5), *range(10, 14)} and all(kind(r.query_id) == kind(r.id) for r in near)
    assert [r.id for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == 0] == [1, 2, 3]


def test_sentences_end_before_any_white_space(spark):
    from fathom.functions import text

    cases = {"One.\u00a0Two!\u3000Three? Four": ["One.", "Two!", "Three?", "Four"], "a.b c": ["a.b c"], "(End.) Next\n\nlast": ["(End.)", "Next", "last"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.sentences(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases


def test_admission_counts_across_seconds(spark):
    from datetime import datetime, timedelta

    rng = np.random.default_rng(3)
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(days=int(rng.integers(0, 3)), seconds=int(rng.integers(0, 20)), milliseconds=int(rng.integers(0, 3))), int(rng.integers(0, 50))) for i in range(300)]
    got = {r.event_id: (r.used_before, r.allowed) for r in usage.admit(spark.createDataFrame(rows, "event_id long, ts timestamp, tokens long"), 900).collect()}
    want, used = {}, {}
    for i, t, n in sorted(rows, key=lambda r: (r[1], r[0])):
        before = used.get(t.date(), 0)
        want[i] = (before, before < 900)
        used[t.date()] = before + n
    assert got == want


def test_rrf_numbers(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank int")
    b = spark.createDataFrame([("b", 1), ("d", 2), ("a", 3)], "id string, rank int")
    got = {r.id: r.score for r in fusion.rrf(a, b).collect()}
    assert got["b"] == pytest.approx(1 / 62 + 1 / 61) and got["a"] == pytest.approx(1 / 61 + 1 / 63)
    assert got["b"] > got["a"] > got["d"]
    top = fusion.rrf(a.where("id = 'a'"), a.where("id = 'a'")).first().score
    assert top == pytest.approx(2 / 61)


def test_chunks_become_documents(spark):
    x = spark.createDataFrame([("a1", 0.95, 1, "paper-a", 1.0), ("a2", 0.91, 2, "paper-a", 2.0), ("b1", 0.80, 3, "paper-b", 1.0), ("solo", 0.5, 4, None, None)], "id string, score double, rank int, parent_doc_id string, chunk_index double")
    top = fusion.top_documents(fusion.documents(x), 10).collect()
    assert [(r.doc_id, r.chunk_id) for r in top] == [("paper-a", "a1"), ("paper-b", "b1"), ("solo", "solo")]


def test_bm25_against_plain_python(docs):
    rows = [(r.id, bm25.query_terms(r.content)) for r in docs.select("id", "content").collect()]
    toks = {i: [w.lower() for w in c.split()] for i, c in ((r.id, r.content) for r in docs.collect())}
    n, avg = len(rows), sum(map(len, toks.values())) / len(rows)

    def score(i, terms):
        out = 0.0
        for t in terms:
            df = sum(t in w for w in toks.values())
            tf = toks[i].count(t)
            out += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[i]) / avg))
        return out

    for query, op in (("language is", "and"), ("language containers", "or")):
        terms = query.split()
        test = all if op == "and" else any
        want = {i: score(i, terms) for i in toks if test(t in toks[i] for t in terms)}
        got = {r.id: r.score for r in bm25.matches(docs, query, operator=op).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert bm25.matches(docs, "xyzzy").count() == 0 and bm25.matches(docs, "!!!").count() == 0


def test_keyword_place_scores(spark):
    one = bm25.keyword_ranked(spark.createDataFrame([("a", 3.0)], "id string, score double"), 10).collect()
    assert [(r.id, r.score) for r in one] == [("a", 1.0)]
    four = bm25.keyword_ranked(spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), ("d", 0.5)], "id string, score double"), 2)
    assert {r.id: r.score for r in four.collect()} == {"a": 1.0, "b": 0.75}


@pytest.mark.parametrize("mode", list(Mode))
def test_modes_hold_the_invariants(searcher, mode):
    found = searcher.search(SearchRequest("language", mode, top_k=4, limit=2))
    hits = found.hits.collect()
    scores = [h.score for h in hits]
    assert len(hits) == 2 and scores == sorted(scores, reverse=True) and all(0 <= s <= 1 for s in scores)
    assert found.total >= 2 and ids(searcher.search(SearchRequest("language", mode, top_k=4, limit=2)).hits) == [h.id for h in hits]
    assert "vector" not in found.hits.columns and "vector" in searcher.search(SearchRequest("language", mode, include_vectors=True)).hits.columns


def test_search_filters_first_and_cuts_scores(searcher):
    only = searcher.search(SearchRequest("anything", Mode.SEMANTIC, Filter(must=(Match("category", "database"),))))
    assert ids(only.hits) == ["doc-4"]
    exact = searcher.search(SearchRequest(DOCS[1][1], Mode.SEMANTIC, min_score=0.999))
    assert ids(exact.hits) == ["doc-2"] and exact.total == 1
    assert searcher.search(SearchRequest("xyzzy", Mode.KEYWORD)).total == 0
    assert searcher.search(SearchRequest("language", Mode.HYBRID, min_score=0.04)).total == 0
    built = searcher.query("language").mode("keyword").where("category", "programming").between("priority", lt=9).limit(5).do()
    assert ids(built.hits) == ["doc-2"]


def test_similar(searcher):
    found = searcher.similar("doc-1", SimilarRequest(top_k=3))
    assert "doc-1" not in ids(found.hits) and found.total == 3
    for unknown in ("nope", "doc-6"):
        with pytest.raises(DocumentNotFound):
            searcher.similar(unknown, SimilarRequest())


def test_sentence_windows():
    assert chunking.sentence_windows([6, 9, 6], 15, 0.25) == [(0, 2), (1, 3)]
    assert chunking.sentence_windows([5, 5], 10, 0.0) == [(0, 2)]
    assert chunking.sentence_windows([], 10) == []
    with pytest.raises(ValueError):
        chunking.sentence_windows([6], 4)


def test_sentences(spark):
    cases = {
        "One. Two!  Three?": ["One.", "Two!", "Three?"], 'He said "yes." Then left.': ['He said "yes."', "Then left."], "a\n\nb": ["a", "b"], "": [], "  \n ": [], "v1.2 is out": ["v1.2 is out"],
        "no  end\there": ["no end here"],
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.sentences(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases


def test_chunking_documents(spark):
    df = spark.createDataFrame([("d", "One two three. Four five six. Seven eight nine.", {"k": "v"}, None), ("e", "Short  one.", None, {"n": 1.0}), ("f", "word " * 40 + ".", None, None)], "id string, content string, tags map<string,string>, numerics map<string,double>")
    cut = chunking.window_chunks(df, window=12, overlap=0.25)
    assert {r.id: r.error is None for r in cut.collect()} == {"d": True, "e": True, "f": False}
    rows = {r.id: r for r in chunking.chunk_documents(cut.where("error is null")).collect()}
    assert set(rows) == {"d-chunk-0001", "d-chunk-0002", "e"}
    assert rows["d-chunk-0002"].tags == {"k": "v", "parent_doc_id": "d"} and rows["d-chunk-0002"].numerics == {"chunk_index": 2.0}
    assert rows["d-chunk-0002"].content == "Four five six. Seven eight nine."
    assert rows["e"].content == "Short  one." and rows["e"].tags == {"parent_doc_id": "e"} and rows["e"].numerics == {"n": 1.0, "chunk_index": 1.0}


def test_fixed_windows(spark):
    df = spark.createDataFrame([("1", " ".join(map(str, range(25)))), ("2", "a b"), ("3", " ")], "id string, content string")
    got = chunking.fixed_windows(df, 12, 2).orderBy("source_doc_id", "chunk_idx").collect()
    assert [(r.chunk_id, r.content.split()[0], r.token_count) for r in got] == [("scifact-1-c0", "0", 12), ("scifact-1-c1", "8", 12), ("scifact-1-c2", "16", 11), ("scifact-2-c0", "a", 4)]


def test_embedding_cache(spark):
    e = embedding.stub(8)
    df = spark.createDataFrame([("1", "aaaa"), ("2", "bbbb"), ("3", "aaaa"), ("4", None)], "id string, content string")
    out, fresh = embedding.embed(df, e, cache=spark.createDataFrame([], "model string, key string, embedding array<float>"))
    assert fresh.count() == 2 and sum(r.total_tokens or 0 for r in out.collect()) == 3
    again, more = embedding.embed(df, e, cache=fresh)
    assert more.count() == 0 and sum(r.total_tokens or 0 for r in again.collect()) == 0
    assert {r.id: r.vector is None for r in again.collect()} == {"1": False, "2": False, "3": False, "4": True}
    other = embedding.instructed(e, "query: ")
    assert other.one("x") == e.one("query: x") and embedding.wrong_dimension(out, 8).count() == 0


def test_embedding_batches(spark):
    def client():
        return lambda texts: [([float(len(t)), 1.0], len(t)) for t in texts]

    out, _ = embedding.embed(spark.createDataFrame([("1", "abc")], "id string, content string"), embedding.from_batches("m", client, 2))
    r = out.first()
    assert r.vector == [3.0, 1.0] and r.total_tokens == 3


SHAPE = "id string, content string, tags map<string,string>, numerics map<string,double>, vector array<float>, revision int"


def test_mutations(spark):
    old = spark.createDataFrame([("1", "one", {"a": "x", "b": "y"}, {"n": 1.0}, None, 1), ("2", "two", None, None, None, 1)], SHAPE)
    new = spark.createDataFrame([("1", "uno", {"a": "z"}, {}, None, 1), ("3", "three", None, None, None, 1)], SHAPE)
    get = lambda df: {r.id: (r.content, r.tags, r.numerics) for r in df.collect()}
    assert get(mutations.upsert_replace(old, new))["1"] == ("uno", {"a": "z"}, {})
    assert get(mutations.upsert_merge(old, new)) == {"1": ("uno", {"a": "z", "b": "y"}, {"n": 1.0}), "2": ("two", {}, {}), "3": ("three", {}, {})}
    change = spark.createDataFrame([("1", None, {"a": None, "c": "w"}, {"n": None, "m": 2.0}), ("9", "x", None, None), ("2", None, None, {})], "id string, content string, tags map<string,string>, numerics map<string,double>")
    assert get(mutations.patch(old, change))["1"] == ("one", {"b": "y", "c": "w"}, {"m": 2.0})
    assert {r.id: r.error_code for r in mutations.patch_status(old, change).collect()} == {"1": None, "9": "document_not_found", "2": "validation_failed"}
    twice = spark.createDataFrame([("1", "first", 1), ("1", "last", 2)], "id string, content string, position int")
    assert ids(mutations.last_of_each(twice, "position"), "content") == ["last"]


def test_usage(spark):
    rows = [(1, datetime(2024, 1, 30, 23, 59), 60), (2, datetime(2024, 1, 31), 50), (3, datetime(2024, 1, 31, 1), 60), (4, datetime(2024, 1, 31, 2), 1), (5, datetime(2024, 2, 1), 5)]
    ev = spark.createDataFrame(rows, "event_id int, ts timestamp, tokens long")
    assert [r.allowed for r in usage.admit(ev, 100).orderBy("event_id").collect()] == [True, True, True, False, True]
    assert all(r.allowed for r in usage.admit(ev, 100, action="warn").collect()) and all(r.allowed for r in usage.admit(ev, 0).collect())
    month = usage.report(ev, "month", datetime(2024, 1, 31, 5), 200).first()
    assert (month.tokens, month.remaining, month.exhausted, month.resets_at) == (171, 29, False, datetime(2024, 2, 1))
    total = usage.report(ev, "total", datetime(2024, 1, 31, 5), 100).first()
    assert (total.tokens, total.start, total.remaining, total.exhausted) == (171, None, 0, True)
    assert usage.report(ev, "day", datetime(2024, 2, 1, 5), 0).first().remaining == -1
    kept = spark.createDataFrame([("day", datetime(2024, 1, 1)), ("month", datetime(2024, 1, 1))], "period string, first_written timestamp")
    assert ids(usage.live_counters(kept, F.lit(datetime(2024, 1, 4))), "period") == ["month"]


def test_evaluation(spark):
    runs = spark.createDataFrame([("m", "q1", "d1", 1), ("m", "q1", "d9", 2), ("m", "q1", "d2", 3), ("m", "q2", "d9", 1)], "mode string, query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("q1", "d1", 1), ("q1", "d2", 2), ("q2", "d5", 1), ("q3", "d1", 1)], "query_id string, doc_id string, score int")
    got = {r.query_id: r for r in evaluate.per_query(runs, rel).collect()}
    dcg, ideal = 1 / math.log2(2) + 3 / math.log2(4), 3 / math.log2(2) + 1 / math.log2(3)
    assert got["q1"].ndcg == pytest.approx(dcg / ideal) and got["q1"].mrr == 1 and got["q1"].recall == 1
    assert (got["q2"].ndcg, got["q2"].mrr, got["q3"].recall, got["q3"].num_results) == (0, 0, 0, 0)
    assert evaluate.summary(evaluate.per_query(runs, rel)).first().queries == 3
    best = spark.createDataFrame([("a", 0.5, 0.7, 9.0, 1.0, 30.0), ("b", 0.6, 0.7, 8.0, 2.0, 20.0)], "run string, ndcg double, recall double, qps double, ingest_rate double, elapsed double")
    assert evaluate.best_runs(best).first().asDict() == {"best_ndcg": "b", "best_recall": "a", "best_qps": "a", "best_ingest_rate": "b", "best_elapsed": "b"}


def test_numeric_order_and_titles(spark):
    df = spark.createDataFrame([("10",), ("9",), ("b",), ("a",)], "id string")
    assert ids(df.orderBy(*text.numeric_order(F.col("id")))) == ["9", "10", "a", "b"]
    t = spark.createDataFrame([(" T ", "x"), ("", "x"), (None, " ")], "t string, x string").select(text.title_and_text(F.col("t"), F.col("x")).alias("v"))
    assert [r.v for r in t.collect()] == ["T\n\nx", "x", ""]


def test_plans_keep_the_shape_that_scales(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(8)], i % 3) for i in range(50)], "id long, vector array<float>, label int")
    plan = knn.knn(filters.apply(df, Filter(must=(Range("label", gte=1),))), [1.0] * 8, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Python" not in plan


def test_unit_length_is_computed_once_per_row(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, []), (3, None), (4, [None, 2.0])], "i int, v array<float>")
    got = {r.i: r.u for r in rows.select("i", vectors.l2_normalize(F.col("v")).alias("u")).collect()}
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0] and got[2] == [] and got[3] is None
    five = F.sequence(F.lit(1), F.lit(5))
    drawn = rows.select(vectors.bound(F.rand(), lambda x: F.array_distinct(F.transform(five, lambda _: x))).alias("d"))
    assert all(len(r.d) == 1 for r in drawn.collect())
