import os

import pytest

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def sf():
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    return d


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", 1, "a", 0.5),
        (2, "the  quick brown fox\njumps over the lazy dog", 2, "b", 0.1),
        (2, "the  quick brown fox\njumps over the lazy dog", 2, "b", 0.1),
        (3, None, None, None, None),
        (4, "", 0, "c", 0.0),
        (None, "an orphan text without id", 4, "d", 0.2),
        (5, long, 5, "e", 0.3),
        (6, " \t\n ", 6, "f", 0.4),
        (7, "x" * 70_000, 7, "g", 0.4),
        (8, "tab\x0band \x1c odd   white\xa0space <|endoftext|> 日本語 👍🏽", 8, "h", None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, rid long, shard string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
