import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathom.llm import components, exactdedup, simhash, substring

from .conftest import make

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(t):
    return [w for w in SPACE.split(t or "") if w]


@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.substring(F.md5(c), 1, 1), lambda c: F.lit("same").cast("string")])
def test_exact_groups(odd, odd_rows, content_hash):
    """Hashes of four bits, or none, collide; bytes still part the groups."""
    norm = [SPACE.sub(" ", t or "") for _, t, _, _ in odd_rows]
    ids = defaultdict(list)
    for (i, *_), t in zip(odd_rows, norm, strict=True):
        ids[t].append(i)
    low = {t: min((i for i in v if i is not None), default=None) for t, v in ids.items()}
    want = Counter((i, low[t], len(ids[t]), i == low[t], hashlib.sha256(t.encode()).hexdigest()) for (i, *_), t in zip(odd_rows, norm, strict=True))
    got = Counter(tuple(r) for r in exactdedup.exact_groups(odd, content_hash=content_hash).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_exact_on_nothing(empty, odd):
    assert exactdedup.exact_groups(empty).count() == 0 and exactdedup.drop_exact_copies(empty).columns == odd.columns


def test_exact_copies_go(spark, odd, odd_rows):
    """One row of each text stays, also where ids are null, shared by different texts or given twice."""
    rows = [*odd_rows, (None, "no id twice", "en", "a"), (None, "no id  twice", "de", "a"), (None, odd_rows[2][1], "en", "a"), (9, odd_rows[1][1], "en", "a"), (9, "second text of nine", "en", "a")]
    best = {}
    for i, t, *_ in rows:
        n = SPACE.sub(" ", t or "")
        best[n] = min(best.get(n, 1 << 62), 1 << 62 if i is None else i)
    want = Counter((None if i == 1 << 62 else i, t) for t, i in best.items())
    out = exactdedup.drop_exact_copies(make(spark, rows))
    assert out.columns == odd.columns
    assert Counter((r.doc_id, SPACE.sub(" ", r.text or "")) for r in out.collect()) == want
    assert sorted(r.text for r in exactdedup.drop_exact_copies(make(spark, rows)).where("doc_id is null").collect()) == ["a row without id", "no id  twice"]


def test_near_copies_go(spark, odd, words):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(4)]
    rows = [(3, texts[0], "en", "a"), (None, texts[0] + " ", "en", "a"), (None, texts[1], "en", "a"), (None, texts[2], "en", "a"), (8, texts[2] + "\n", "en", "a"), (2, texts[3], "en", "a"), (1, texts[3].upper(), "en", "a"), (None, None, "en", "a")]
    out = simhash.drop_near_copies(make(spark, rows))
    assert out.columns == odd.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(3, texts[0]), (None, texts[1]), (8, texts[2] + "\n"), (1, texts[3].upper()), (None, None)])


def brute_fingerprint(text, k=3):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Smallest id reachable, for (id, fp) with ids that are not null."""
    items = list(fps)
    label = list(range(len(items)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(items)):
        groups[root(i)].append(items[i][0])
    return {x: min(g) for g in groups.values() for x in g}


def test_simhash_groups(odd, odd_rows):
    fps = [(i, brute_fingerprint(t)) for i, t, _, _ in odd_rows]
    comp = brute_components((i, f) for i, f in fps if i is not None)
    got = simhash.near_groups(odd).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for i, f in fps)
    assert all(r.component_id == comp[r.doc_id] for r in got if r.doc_id is not None)


def test_documents_without_id_bridge_others(spark, words):
    """Two texts too far apart for a link, and one without an id between them."""
    rng = random.Random(21)
    base = [rng.choice(words) for _ in range(300)]
    while True:
        steps = [list(base)]
        for _ in range(2):
            w = list(steps[-1])
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(words)
            steps.append(w)
        a, b, c = (brute_fingerprint(" ".join(w)) for w in steps)
        if (a ^ b).bit_count() <= 3 and (b ^ c).bit_count() <= 3 and (a ^ c).bit_count() > 3:
            break
    rows = [(5, " ".join(steps[0]), "en", "a"), (None, " ".join(steps[1]), "en", "a"), (9, " ".join(steps[2]), "en", "a")]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(make(spark, rows)).collect()}
    assert got == {5: 5, 9: 5, None: 5}


def test_simhash_on_nothing(empty):
    assert simhash.near_groups(empty).count() == 0


def test_masks_cover_every_triple():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    rng = random.Random(1)
    for _ in range(20_000):
        bits = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & bits for m in masks)
    assert min(m.bit_count() for m in masks) >= 30


def test_links_lose_nothing_in_crowded_buckets(spark):
    """A ball of near fingerprints that fills buckets beyond a block, a chain, and strangers."""
    rng = random.Random(2)
    ball, out = rng.getrandbits(64), set()
    while len(out) < 250:
        out.add(ball ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    chain = rng.getrandbits(64)
    for _ in range(12):
        chain ^= sum(1 << b for b in rng.sample(range(64), 3))
        out.add(chain)
    out |= {rng.getrandbits(64) for _ in range(100)}
    items = list(enumerate(sorted(out)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in items], "fp long, rep long")
    want = {k: v for k, v in brute_components(items).items()}
    for block in (16, 2048):
        found = simhash.links(df, block=block).cache()
        got = {r.node: r.component for r in components.connected_components(found).collect()}
        assert {i: got.get(i, i) for i, _ in items} == want
        fp = dict(items)
        assert all((fp[r.a] ^ fp[r.b]).bit_count() <= 3 for r in found.collect())


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    assert got == {x: reach(x) for x in list(near) if near[x]}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_a_hub_are_split(spark):
    """One node with most links: the join of a round does not leave them to one task."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hub = spark.range(40_000).selectExpr("7L AS u", "id + 100 AS v").unionByName(spark.range(300).selectExpr("id + 100000 AS u", "id + 100300 AS v"))
        both = components.materialize(hub.unionByName(hub.selectExpr("v AS u", "u AS v")).repartition(8), "both")
        low = components.materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
        joined = components._to_smallest(both, low)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        assert components.connected_components(hub.selectExpr("u AS a", "v AS b")).where("component = 7").count() == 40_001
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from fathom.sources import scratch

    session = lambda master, base=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: base), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    assert scratch.shared_dir(session("yarn", "hdfs:///c")) == "hdfs:///c" and scratch.shared_dir(session("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch.shared_dir(session(master))


def brute_repeats(rows, window):
    toks = [words_of(t) for _, t, *_ in rows]
    count = Counter(tuple(w[i : i + window]) for w in toks for i in range(len(w) - window + 1))
    out = []
    for (i, *_), w in zip(rows, toks, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, " ".join(kept), len(w), len(w) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize(("window", "cells"), [(35, 8), (6, 8), (6, 1), (4, 64)])
def test_repeats(odd, odd_rows, monkeypatch, window, cells):
    """Small blocks put passages into many blocks; small sketches let more pass, and small slices make many of them."""
    monkeypatch.setattr(substring, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(substring, "SLICE_BITS", 12)
    monkeypatch.setattr(substring, "SAME_ROWS", 1)
    got = Counter(tuple(r) for r in substring.remove_repeats(odd, window=window, cells=cells).select("doc_id", "kept", "n_words", "n_removed").collect())
    assert got == brute_repeats(odd_rows, window)


def test_many_rows_of_one_id_and_text(spark, words):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(1, text(80), "en", "a")] * 40 + [(None, text(70), "en", "a")] * 30 + [(2, text(90), "en", "a"), (None, text(20), "en", "a")]
    got = Counter(tuple(r) for r in substring.remove_repeats(make(spark, rows)).select("doc_id", "kept", "n_words", "n_removed").collect())
    assert got == brute_repeats(rows, 35)


def test_sketch_overestimates_window_counts(spark, words):
    """Every window that stands at two places passes; of unique ones few do, whatever the size."""
    import pyarrow as pa

    rng = random.Random(13)
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(40)]
    texts[7] = texts[3][:900] + " " + texts[7]
    bits = 17
    rows = spark.createDataFrame([(i % 4, i, t.encode(), 1) for i, t in enumerate(texts)], "block long, id long, text binary, n long")
    flags = substring._sketch(rows, bits, 35).toArrow()
    table = rows.toArrow()
    count, passed, unique = Counter(), {}, 0
    for b in range(4):
        own = table.filter(pa.compute.equal(table.column("block"), b)).combine_chunks()
        _, _, pairs = substring._windows(substring._text(own), 35)
        count.update(map(tuple, pairs.tolist()))
        _, at, kept, _ = substring._candidates(own, flags.filter(pa.compute.equal(flags.column("block"), b)), bits, 35)
        for p in map(tuple, kept.tolist()):
            passed[p] = passed.get(p, 0) + 1
    assert all(passed.get(p) == n for p, n in count.items() if n > 1) and any(n > 1 for n in count.values())
    unique = [p for p, n in count.items() if n == 1]
    assert 0 < sum(p in passed for p in unique) < 0.25 * len(unique)


def test_coded_cells():
    rng = np.random.default_rng(4)
    for n, top in ((0, 9), (1, 1 << 22), (50, 1 << 22), (3000, 1 << 22), (4000, 4096)):
        cells = np.sort(rng.choice(top, n, replace=False)).astype("i8")
        twice = rng.random(n) < 0.5
        import pyarrow as pa

        back, flags = substring._decoded(pa.py_buffer(substring._coded(cells, twice)))
        assert back.tolist() == cells.tolist() and flags.tolist() == twice.tolist()


def test_repeats_across_and_within(spark, words):
    rng = random.Random(8)
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(25):
        own = lambda n: [rng.choice(words) for _ in range(n)]
        parts = own(rng.randint(0, 80)) + (passage[rng.randint(0, 10) : rng.randint(45, 60)] if i % 3 else []) + own(rng.randint(0, 30)) + (passage if i % 7 == 0 else [])
        rows.append((i, ("\t" if i % 2 else " ").join(parts), "en", "a"))
    rows.append((99, " ".join(["same"] * 100), "en", "a"))
    got = Counter(tuple(r) for r in substring.remove_repeats(make(spark, rows)).select("doc_id", "kept", "n_words", "n_removed").collect())
    assert got == brute_repeats(rows, 35) and sum(r[3] for r in got) > 200


def test_repeats_on_nothing(empty):
    assert substring.remove_repeats(empty).count() == 0
