import random

import numpy as np
import pytest

import corpus_pipeline
from fathom.llm import jaccard

from .conftest import make


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a and b else 0


def copy_rows(words):
    """Copies of 12 to 120 words with some words changed or added, a group of copies of copies, and a common line."""
    rng = random.Random(31)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(12, 120)), "en", "a") for i in range(60)]
    for i in range(60):
        w = rows[i][1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((100 + i, " ".join(w + text(rng.randint(1, 2)).split()), "en", "a"))
    base, line = text(70), text(12)
    for i in range(50):
        w = base.split()
        w[i] = rng.choice(words)
        rows += [(300 + i, " ".join(w), "en", "a"), (400 + i, line + " " + text(rng.randint(1, 30)), "en", "a")]
    return [*rows, (500, base, "en", "a"), (501, "", "en", "a"), (502, None, "en", "a"), (503, "two words", "en", "a"), (504, "Two  words", "en", "a")]


def brute_groups(rows):
    low = {r[0]: r[0] for r in rows}
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and similarity(a[1], b[1]) >= 0.8]
    for _ in rows:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return low, pairs


@pytest.mark.parametrize("block", [8, 512])
def test_links_join_all_near_copies_and_no_others(spark, words, monkeypatch, block):
    """Small blocks leave a common line's documents to many tasks."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = copy_rows(words)
    low, pairs = brute_groups(rows)
    assert len(pairs) > 80
    found = [(r.a, r.b) for r in jaccard.links(make(spark, rows)).collect()]
    assert set(found) <= set(pairs)
    got = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in found:
            got[a] = got[b] = min(got[a], got[b])
    assert got == low


def test_pipeline_stage_drops_short_near_copies(spark, words):
    rows = copy_rows(words)
    low, _ = brute_groups(rows)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, make(spark, rows), "").collect()}
    assert 0 in got and not [i for i in got if low[i] != i]


def test_near_copies_of_nothing(spark, empty):
    assert jaccard.drop_near_copies(empty).count() == 0 and jaccard.links(empty).count() == 0


def test_sketches_never_overstate_a_difference():
    """Folded or not, two sketches differ in no more cells than the sets do in shingles; unrelated sets are ruled out."""
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(-(1 << 62), 1 << 62, n)
    for n in (1, 5, 63, 64, 65, 500, 3000):
        base = np.unique(draw(n))
        for changed in (0, 1, n // 10, n // 4):
            other = np.unique(np.concatenate([base[changed:], draw(changed)]))
            a, b = jaccard.sketch(base), jaccard.sketch(other)
            words = min(len(a), len(b))
            a, b = (np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in (a, b))
            assert np.bitwise_count((a ^ b).view("u8")).sum() <= len(np.setxor1d(base, other))
        if n >= 63:
            a, b = jaccard.sketch(base).view("u8"), jaccard.sketch(np.unique(draw(len(base)))).view("u8")
            assert np.bitwise_count(a ^ b).sum() * (jaccard.DEN + jaccard.NUM) > 2 * len(base) * (jaccard.DEN - jaccard.NUM)
