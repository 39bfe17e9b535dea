import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, source]) rows."""

    def make(rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        return df.selectExpr("*", *([extra] if extra else []))

    return make


@pytest.fixture
def prose():
    """Invented prose, the same for the same seed."""

    def make(words, seed, vocabulary=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))

    return make
