import random

import pytest

from lexfit.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _bin long, score double, f long"


@pytest.fixture(scope="session")
def spark(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names clash with what operators make."""

    def build(texts, sources=None, langs=None, ids=None):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        rows = [(ids[i], texts[i], (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], len(texts[i] or ""), -1, -1, -1.0, -1) for i in range(n)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank and very long texts, other white space, marks, and repeats."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "Δelta", "the", "of"]) + str(rng.randint(0, 400)) for _ in range(20000))
    return [None, "", " \n\t ", "one", "one", "É a b\x1cc\x0bd", "x\0y z", long, long, "a b c d e f g h", "A B C D E F G H", "#*$ %&| <> word's <|endoftext|> 12,5 ẞ İ"]
