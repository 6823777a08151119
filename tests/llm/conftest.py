import random

import pytest


@pytest.fixture(scope="session")
def odd_rows():
    """Rows that every operator has to bear: nulls, empty and long texts, repeated rows, clashing columns."""
    draws = random.Random(3)
    words = ["alpha", "beta", "Gamma,", "delta", "né", "x", "the", "of", "ünder"]

    def text(n):
        return " ".join(draws.choice(words) for _ in range(n))

    common, near = text(90), text(60).split()
    rows = [(1, None), (2, ""), (3, " \n"), (4, text(40)), (5, common), (6, common), (6, common), (None, text(30)), (None, None)]
    rows += [(10 + i, text(20) + " " + common + " " + text(15)) for i in range(6)]
    rows += [(30 + i, " ".join(near[:55 + i])) for i in range(5)]
    rows += [(50, "a" * 900), (51, "ab" * 450), (52, ("same line here\n" * 60)), (53, text(3000)), (54, "123 456"), (55, "x")]
    return rows


SCHEMA = "doc_id long, text string, shard int, n long, spans string, key long, size long, lang string, source string"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame([(i, t, 1, None, "s", 3, 4, "en", None) for i, t in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
