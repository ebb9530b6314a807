import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of texts; ids count from 0 unless given. Columns whose names the operators use inside are added."""

    def build(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, None if n % 3 == 0 else "en", None, None if t is None else len(t)) for n, (i, t) in enumerate(zip(ids, texts))]
        df = spark.createDataFrame(rows, DOCS)
        for name in ("key", "_key", "_id", "_row", "row", "node", "n", "packed", "hits", "words", "part", "bits", "pattern", "toxicity", "hash"):
            df = df.withColumn(name, F.lit("clash"))
        return df.repartition(3)

    return build


@pytest.fixture(scope="session")
def awkward(make):
    """Nulls, empty and blank texts, a very long one, repeated rows, copies, odd white space, a null id, one long word."""
    a, b = prose(1, 120), prose(2, 90)
    texts = [None, "", " \n\t ", "one", prose(3, 30000), a, a, a + " end", b, "é è x\x85y " * 20, "x" * 5000, b.upper(), None, b]
    return make(texts, [0, 1, 2, 3, 4, 5, 5, 7, 8, 9, 10, 11, None, None])


@pytest.fixture(scope="session")
def empty(make):
    return make(["x"]).where("doc_id < 0")
