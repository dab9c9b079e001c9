"""Awkward documents that every operator has to take."""

from __future__ import annotations

import random

import pytest

#: Names as operators name their own columns, one with a dot, one with a backtick, and one that differs from ``text`` in case only.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, node double, keep string, score int, language string, total int, ids string, toxicity string, cut string, label string, `meta.url` string, `a``b` int, Text string"
#: Columns beside those of ``documents``, named as operators name theirs.
CLASHES = ("x", 1.5, None, 7, "zz", 1, "i", "t", "c", "l", "u", 3, "other")


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


LONG = words(1, 150_000)
ROWS = [
    (1, words(2, 60), "en", "a", 1),
    (2, words(2, 60), "en", "a", 1),  # a copy
    (3, words(2, 60) + " tail end", "en", "b", 1),  # a near copy
    (4, None, "en", "a", None),
    (5, "", None, None, 0),
    (6, " \n\t ", "de", "b", 3),
    (None, words(3, 40), "en", "a", 1),
    (None, None, None, None, None),
    (7, LONG, "en", "b", len(LONG)),
    (8, LONG, "fr", "b", len(LONG)),
    (9, "one", "en", "a", 3),
    (10, "one", "en", None, 3),
    (11, "!!! ... ???", "en", "a", 11),
    (12, words(4, 30), None, "a", 1),
    (12, words(4, 30), None, "a", 1),  # a repeated row
    (14, " " * 1_200_000 + "x", "en", "b", 1),
    (15, "abcdefghij" * 50_000, "en", "b", 1),  # one word
    (16, "\n" * 1_200_000, "en", "b", 1),
    (13, "東京 naïve İstanbul \U0001f600 \u0000   café", "ja", "c", 20),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, *CLASHES) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
