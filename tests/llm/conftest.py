import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = ("lorem ipsum dolor sit amet " * 4000).strip()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and columns that operators use inside."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "日本", "x1", "it's"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base = text(60)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, "", "en", None), (4, None, None, "b"), (None, base + " tail", "fr", "b"), (None, None, None, None)]
    rows += [(5, " \t\n ", "de", "c"), (6, "12 34 !?", "de", "c"), (7, LONG, "la", "a"), (8, LONG + " end", "la", "a"), (9, "a" * 50_000, "en", "d"), (10, "one two", None, "d")]
    rows += [(i, text(rng.randint(0, 80)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(11, 40)]
    extra = ", fp long, id long, key string, bucket int, start int, _c0 string, part int, score double, size int"
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, 2, "k", 3, 4, "c", 5, 0.5, 6) for r in rows], DOCS + extra)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
