import random

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def prose():
    """A maker of random prose: prose(seed, words)."""

    def make(seed, words=60):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(words))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of documents from (doc_id, text) pairs, with columns that clash with internal names."""

    def make(rows, clash=True):
        rows = [(i, t, "en", None if i is None else f"src{i % 3}", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(rows, DOCUMENTS)
        if clash:
            for name in ("doc", "id", "fp", "key", "label", "score", "size", "hash", "bucket", "first", "list", "t"):
                df = df.withColumn(name, F.lit("kept"))
        return df

    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Null id, null and empty and blank texts, repeated rows, copies, a long text."""
    text = prose(1)
    return [
        (1, text), (2, text), (2, text), (3, None), (4, ""), (None, text), (None, None), (5, " \t\n "), (6, "one"),
        (7, prose(2, 30_000)), (8, "a" * 50_000),
    ]
