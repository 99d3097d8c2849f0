"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, count: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(count)]


@pytest.fixture(scope="session")
def awkward(spark):
    rng = random.Random(3)
    base = " ".join(words(rng, 60, 10_000))
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, base + " tail", None, None, len(base) + 5),
        (4, None, "en", "b", None),
        (5, "", "en", "b", 0),
        (6, " \n\t ", "en", None, 4),
        (7, "one", "en", "b", 3),
        (8, "One two THREE", "en", "b", 13),
        (None, "no id here at all for once", "en", "c", 26),
        (9, " ".join(words(rng, 30_000, 50_000)), "en", "c", None),
        (10, "same " * 500, "en", "c", 2500),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with columns named like those the operators add."""
    return awkward.selectExpr(
        "*", "1 as size", "2 as target", "3 as kept", "4 as row", "5 as hash_", "6 as label", "7 as n",
        "8 as evidence", "9 as score", "10 as node", "11 as `odd name`",
    )


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
