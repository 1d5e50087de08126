import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import bpe, covertree, merkle, urlfilter
from fathom.llm.queries import PATTERN, RANKS

from .conftest import make
from .test_dedup import SPACE, brute_components, brute_fingerprint

VECTORS = "vec_id long, embedding array<float>, label int, id string, vec int, rep long, cell int, n_links string"


def vector_rows():
    rng = np.random.default_rng(3)
    rows = []
    for label in range(3):
        centers = rng.normal(size=(6, 8))
        for c in centers:
            rows += [(c + rng.normal(size=8) * s, label) for s in (0, 0.02, 0.02, 0.05, 0.2, 0.2)]
        hub = rng.normal(size=8)
        rows += [(hub + rng.normal(size=8) * 0.03, label) for _ in range(60 if label == 1 else 5)]
        rows += [(rng.normal(size=8), label) for _ in range(20)]
    rows = [(x.astype("f4").tolist(), label) for x, label in rows]
    rows += [rows[0]] * 5 + [([2 * v for v in rows[0][0]], 0), ([1e-30] * 8, 0), ([3e30] * 8, 0)]
    bad = [(None, 0), ([], 0), ([0.0] * 8, 0), ([float("nan")] * 8, 0), ([float("inf")] + [1.0] * 7, 0), ([None] + [1.0] * 7, 0), (rows[0][0], None), (rows[0][0][:4], 0)]
    return [(i, v, label) for i, (v, label) in enumerate(rows + bad)]


def brute_links(rows):
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, "f8")
            x /= np.abs(x).max()
            good[i] = (label, x / np.sqrt(x @ x))
    links = {i: set() for i, *_ in rows}
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i < j and a == b and len(x) == len(y) and x @ y >= 0.98:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("block", [12, 40, 2048])
def test_near_vectors(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, label, "x", 1, 2, 3, "y") for i, v, label in rows], VECTORS).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df, block=block).collect()}
    want = brute_links(rows)
    assert got == want and max(n for n, *_ in want.values()) >= 50
    assert covertree.near_vectors(df.where("false")).count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df).collect())
    assert got == Counter({(None, 0, None, False): 1, (4, 1, 4, True): 2, (5, 0, 5, True): 1})


def test_one_id_for_different_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df).collect())
    assert got == Counter({(1, 1, 1, True): 2, (2, 1, 1, False): 1, (3, 1, 1, False): 1})


def test_large_cells_are_split_by_pivots_of_their_own(spark):
    """Clusters far apart in one label: few of all pairs of blocks are left to compare, and no link is lost."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 32))
    x = np.concatenate([c + rng.normal(size=(120, 32)) * 0.04 for c in centers])
    rows = [(i, v, 1) for i, v in enumerate(x.astype("f4").tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df, block=40).collect()}
    assert got == brute_links(rows)
    classes = df.selectExpr("label", "embedding AS vec", "1L AS copies", "size(embedding) AS dim", "vec_id AS rep")
    dealt, pivots = covertree._cells(classes, len(rows), 400)
    members, subs = covertree._split(dealt.withColumn("cell_far", F.col("far")), 40)
    pairs = covertree._pairs(members, pivots, subs, 40, 0.98)
    blocks = members.select("cell", "sub").distinct().count()
    assert subs.count() > 20 and pairs.select("cell", "sub", "cell2", "sub2").distinct().count() < 0.5 * blocks * blocks / 2


def test_tree_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16))
    x[:300] = x[0] + rng.normal(size=(300, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, todo, seen = covertree.cover_tree(x), [], 0
    todo.append(tree)
    while todo:
        n = todo.pop()
        seen += 1
        assert np.linalg.norm(x[n.members] - x[n.center], axis=1).max() <= n.radius + 1e-6
        if n.children:
            assert sorted(np.concatenate([c.members for c in n.children])) == sorted(n.members) and n.children[0].center == n.center
            todo += n.children
    assert seen > 50
    for cosine in (0.98, 0.9, 0.5):
        found = [(i, j) for a, b in covertree.pairs_within(x, tree, x, tree, cosine) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= cosine), strict=True)}
        assert len(found) == len(set(found)) and set(found) == want


def test_spanning_labels():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, m = 30, int(rng.integers(0, 40))
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        label = np.arange(n)
        for _ in range(n):
            for a, b in zip(i, j, strict=True):
                label[a] = label[b] = min(label[a], label[b])
        assert covertree.spanning_labels(n, i, j).tolist() == label.tolist()


PAGES = "page_id long, url string, html string, node long, digest string, replica int, number long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 9, 9) for r in rows], PAGES).repartition(3)


def test_audit(spark):
    base = [(i, f"http://h/{i}", "x" * (i % 50)) for i in range(-70, 5000, 3)] + [(9000, None, None), (9001, "u", ""), (9002, "u", "y" * 300_000), (12, "twice", "b"), (12, "twice", "b"), (None, "n", "n")]
    assert merkle.audit(pages(spark, base), pages(spark, base[::-1])).count() == 0
    other = [r for r in base if r[0] not in (-70, 500)]
    other = [(r[0], r[1], r[2] + "!") if r[0] in (-1, 2, 4997) else r for r in other]
    other[other.index((9001, "u", ""))] = (9001, "u", None)
    other.remove((12, "twice", "b"))
    other += [(7, "new", "n"), (100_000, "far", "n")]
    want = {-70: "missing", 500: "missing", -1: "altered", 2: "altered", 4997: "altered", 9001: "altered", 12: "altered", 7: "extra", 100_000: "extra"}
    length = lambda u, h: len("WARC/1.1\r\nWARC-Type: resource\r\n\r\n\r\n\r\n") + (len(f"WARC-Target-URI: {u}\r\n") if u is not None else 0) + (len(f"Content-Length: {len(h)}\r\n{h}") if h is not None else 0)
    room, size = {}, {}
    for side in (other, base):  # the first archive's own length counts
        sums = Counter()
        for i, u, h in side:
            if i is not None:
                sums[i] += length(u, h)
        room |= sums
        size = dict(sums)
    at, offset, places = 0, 0, {}
    for i in sorted(room):
        places[i] = (offset, at >> 16 << 16)
        at, offset = at + room[i], offset + size.get(i, 0)
    got = {r.page_id: (r.status, r.offset, r.range_start) for r in merkle.audit(pages(spark, base), pages(spark, other)).collect()}
    assert got == {i: (s, *places[i]) for i, s in want.items()} and len({p[1] for p in places.values()}) > 3


def test_audit_of_large_and_sparse_numbers(spark):
    """Numbers beyond 2^53 keep apart, and levels shrink however far numbers lie from each other."""
    base = [((1 << 62) + 7 * i, f"u{i}", "x" * 900) for i in range(400)] + [(i * 977_123_456_789, f"v{i}", "y" * 900) for i in range(400)]
    other = [(n, u, h + "!" if k in (5, 6, 500) else h) for k, (n, u, h) in enumerate(base) if k != 399]
    got = {r.page_id: r.status for r in merkle.audit(pages(spark, base), pages(spark, other)).collect()}
    assert got == {base[5][0]: "altered", base[6][0]: "altered", base[500][0]: "altered", base[399][0]: "missing"}


def test_audit_of_nothing(spark):
    none, some = pages(spark, []), pages(spark, [(1, "u", "h")])
    assert merkle.audit(none, none).count() == 0
    assert [r.status for r in merkle.audit(some, none).collect()] == ["missing"] and [r.status for r in merkle.audit(none, some).collect()] == ["extra"]


def test_records_cannot_be_confused(spark):
    rows = [(1, "u", "h"), (1, None, "h"), (1, "u", None), (1, "u", ""), (1, "", "h"), (1, "u\r\nContent-Length: 1", "h")]
    texts = [r[0] for r in pages(spark, rows).select(merkle.warc_record()).collect()]
    assert len(set(texts)) == len(rows)


DAY = datetime(2024, 1, 1)


def test_hosts(spark):
    cases = {
        "HTTP://User:pw@WWW.Example.org:8080/a?b#c": "www.example.org", "https://example.org.": "example.org", "ftp://[::1]:21/x": "[::1]", "example.org/x": None, "": None, "http:///x": None, None: None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urlfilter.host(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in got} == cases


def test_long_hosts_match_by_their_ends(spark):
    long = ".".join("ab" for _ in range(20_000))
    captures = [(1, f"http://{long}.listed.org/"), (2, f"http://{long}/"), (3, f"http://{'x' * 400}.listed.org/"), (4, f"http://{'y' * 300}/"), (5, "http://a.listed.org/")]
    c = spark.createDataFrame([(i, u, DAY + timedelta(days=3)) for i, u in captures], "page_id long, url string, fetched timestamp")
    e = spark.createDataFrame([("listed.org", DAY, "add"), ("y" * 300, DAY, "add")], "domain string, listed timestamp, action string")
    assert {r.page_id: r.matched_domain for r in urlfilter.judge(c, e).collect()} == {1: "listed.org", 2: None, 3: "listed.org", 4: "y" * 300, 5: "listed.org"}


def test_captures_are_judged_by_their_day(spark):
    rng = random.Random(7)
    names = ["a.org", "x.a.org", "b.com", "deep.x.a.org", "org"]
    entries = [(rng.choice(names[:4]), DAY + timedelta(days=rng.randrange(200)), rng.choice(["add", "remove", "ADD"])) for _ in range(60)]
    entries += entries[:5] + [(None, DAY, "add"), ("", DAY, "add"), ("b.com", None, "add"), (".A.org.", DAY + timedelta(days=3), "add"), ("b.com", DAY, None)]
    captures = [(i, f"http://{rng.choice(names)}/{i}", DAY + timedelta(days=rng.randrange(-5, 220), hours=rng.choice([0, 5]))) for i in range(300)]
    captures += [captures[0], (900, None, DAY), (901, "http://a.org", None), (902, "not a url", DAY), (903, "http://" + ".".join("ab" for _ in range(20_000)) + "/", DAY), (None, "http://a.org/", DAY + timedelta(days=150))]
    changes = {}
    for d, t, a in entries:
        if d and t and a and (n := d.lower().strip(".")):
            changes.setdefault(n, {}).setdefault(t, []).append(a.lower())

    def listed(name, t):
        state, since = False, None
        for at in sorted(x for x in changes.get(name, {}) if x <= t):
            on = "remove" not in changes[name][at]
            since = at if on and not state else since if on else None
            state = on
        return since

    want = Counter()
    for i, u, t in set(captures):
        hit = None
        if u and t and u.startswith("http://") and len(u) < 300:
            labels = u[7:].split("/")[0].split(".")
            hit = next(((n, s) for k in range(len(labels)) if (s := listed(n := ".".join(labels[k:]), t))), None)
        want[i, u, t, hit is not None, hit[0] if hit else None, hit[1] if hit else None] += 1
    c = spark.createDataFrame([(*x, "p", "q") for x in captures], "page_id long, url string, fetched timestamp, host string, domain string").repartition(3)
    e = spark.createDataFrame([(*x, "z") for x in entries], "domain string, listed timestamp, action string, until string")
    got = Counter((r.page_id, r.url, r.fetched, r.blocked, r.matched_domain, r.listed_since) for r in urlfilter.judge(c, e).collect())
    assert got == want and sum(k[3] for k in got) > 50
    assert urlfilter.judge(c.where("false"), e).count() == 0 and urlfilter.judge(c, e.where("false")).where("blocked").count() == 0


def test_pipeline_against_its_parts(spark, tmp_path, words):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(5, 80)), "en" if i % 2 else "fr", f"s{i % 5}" if i % 9 else None) for i in range(80)]
    rows += [(100 + i, rows[i][1].replace(" ", "  "), "en", "s1") for i in range(15)]
    rows += [(200, None, "en", "s1"), (201, "123 !!!", None, "s2"), (202, "", "en", "s2")]
    long = text(3000)
    rows += [(300, long, "en", "s3"), (301, long + " end", "en", "s3"), (302, "x" * 2_000, "en", "s4")]
    make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))

    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = {}
    for i, t, *_ in sorted(kept):
        first.setdefault(SPACE.sub(" ", t), i)
    kept = [r for r in kept if first[SPACE.sub(" ", r[1])] == r[0]]
    comp = brute_components((r[0], brute_fingerprint(r[1])) for r in kept)
    kept = [r for r in kept if comp[r[0]] == r[0]]
    from .test_tokens_and_mix import brute_targets

    _, target = brute_targets(kept)
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.Vocabulary.read(RANKS).ranks, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(corpus_pipeline.STAGES) == 5 and all(r.exact for r in got)
    by_id = {r[0]: r for r in kept}
    assert {r.doc_id for r in got} <= set(by_id) and 301 not in {r.doc_id for r in got}
    taken = Counter()
    for r in got:
        t = lib.decode(r.ids)
        taken[by_id[r.doc_id][3]] += len(t.split())
        assert (t == by_id[r.doc_id][1] or by_id[r.doc_id][1].startswith(t)) and r.ids == lib.encode_ordinary(t) and r.n_tokens == len(r.ids)
    assert all(abs(taken[s] - target[s]) < 1 for s in target)


def test_pipeline_on_odd_rows(spark, odd, odd_rows, tmp_path):
    """Null ids, texts and sources, repeated rows, very long texts and columns whose names clash with those of the stages."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.Vocabulary.read(RANKS).ranks, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = [lib.decode(r.ids) for r in got]
    known = {t for _, t, *_ in odd_rows if any(c.isalpha() for c in t or "")}
    assert got and all(r.exact and r.n_tokens == len(r.ids) for r in got)
    assert all(t in known or any(k.split()[: len(t.split())] == t.split() for k in known) for t in texts)
    assert {r.doc_id for r in got} <= {i for i, *_ in odd_rows} and not {100, 101, 102, 105} & {r.doc_id for r in got}
    assert not {200 + i for i in range(8)} & {r.doc_id for r in got}  # copies of document 3


def test_pipeline_on_nothing(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
