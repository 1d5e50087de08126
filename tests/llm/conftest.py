import random

import pytest

#: documents with columns whose names the operators use themselves.
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id long, size int, kept string, h string, t string, fp int, block int, key string, component_id int"
CLASH = (None, 7, "no", "h", "t", 3, 4, "k", -1)


def make(spark, rows):
    """From (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *CLASH) for i, t, lang, s in rows], SHAPE).repartition(3)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows and copies."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(1, 120)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", None])) for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \t\n ", "en", "a"), (103, "x" * 200_000, "en", "b"), (104, "word " * 20_000, "en", "b"), (105, "!!! 123", "en", "c"), (None, "a row without id", "en", "a")]
    rows += [(200 + i, rows[3][1].replace(" ", "\n  "), "en", "a") for i in range(8)] + [(300, rows[5][1] + " tail", "en", "b"), (7, rows[7][1], "fr", "c"), rows[8], rows[8]]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def empty(spark, odd):
    return odd.where("false")
