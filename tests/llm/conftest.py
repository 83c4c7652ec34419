import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, spans string"


def documents(spark, rows, schema=DOC_SCHEMA):
    """Documents from (doc_id, text), with extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in rows], schema)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choice(vocabulary) for _ in range(n))
