import math
import random
from collections import Counter

from fathom.operators import bm25
from fathom.plans import registry


def test_batch_ranks_by_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    names = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(names) for _ in range(n))
    docs = {i: text(rng.randint(1, 40)) for i in range(80)} | {80: "last", 81: ""}
    asked = {i: text(rng.randint(10, 50)) for i in range(6)} | {6: "w1 w2 w3 w4 w5 w6 last", 7: "nowhere"}
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tf = {i: Counter(t.split()) for i, t in docs.items()}
    mean = sum(c.total() for c in tf.values()) / len(tf)
    want = {}
    for q, t in asked.items():
        scores = {}
        for term in set(t.split()):
            df = sum(term in c for c in tf.values())
            for i, c in tf.items():
                if term in c:
                    idf = math.log(1 + (len(tf) - df + 0.5) / (df + 0.5))
                    scores[i] = scores.get(i, 0) + idf * c[term] * (bm25.K1 + 1) / (c[term] + bm25.K1 * (1 - bm25.B + bm25.B * c.total() / mean))
        for rank, i in enumerate(sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:5], 1):
            want[q, rank] = (i, round(scores[i], 6))
    got = {(r.query_id, r.rank): (r.id, r.score) for r in registry.QUERIES["bm25_batch_whole"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and any(i == 80 for i, _ in got.values())
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
