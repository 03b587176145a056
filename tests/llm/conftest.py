import random

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text), with a column whose name an operator uses itself."""

    def build(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, comp string")

    return build


@pytest.fixture(scope="session")
def prose():
    """Words of an invented text, always the same for a seed."""

    def build(seed, count, vocabulary=4000):
        draw = random.Random(seed)
        return [f"w{draw.randrange(vocabulary)}" for _ in range(count)]

    return build
