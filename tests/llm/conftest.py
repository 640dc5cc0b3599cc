import random

import pytest

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work".split()


@pytest.fixture
def prose():
    """A function that makes n random words from a seed."""

    def make(n: int, seed: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.5) for _ in range(n))

    return make


@pytest.fixture
def docs(spark):
    """A function that makes a table of documents, with columns that clash with what operators return."""

    def make(texts: list, ids: list | None = None):
        rows = [(i, t, "en", "s", 0, 7, True) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines int, kept boolean")

    return make
