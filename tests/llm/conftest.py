from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for their own columns.
CLASHES = ("score", "ids", "decoded", "kept", "_key", "_id", "_bucket", "_train", "_label", "id", "fp", "comp", "media", "payload", "lang_pred", "n_words", "rows", "_t", "_w", "quality", "p", "words", "removed", "_hot", "kept_text", "rgb", "a.b", "text.x")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice(("an", "the", "re", "lo", "mi", "st", "or")) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + "." * (i % 9 == 8) for i, w in enumerate(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, wordless and very long texts, repeated rows, equal ids, copies."""
    text = prose(1, 60)
    return [
        (1, text, "en", "a", 5), (2, text, "en", "a", 5), (2, text, "en", "a", 5), (3, None, "en", "a", None), (4, "", None, None, None), (5, " \t\n\x0b\x0c\r ", "fr", "b", 1), (None, text, "en", "a", 1), (None, None, None, None, None),
        (6, prose(2, 40_000), "en", "a", 1), (7, text + " tail", "de", "c", 1), (7, prose(3, 30), "de", "c", 1), (8, "x" * 50_000, "es", "d", 1), (9, "One", "en", "a", 3), (10, "né à naïvé 日本 <|endoftext|> \x1c \x00 .", None, "a", 3), (11, prose(4, 300), "en", "a", 2),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("mine").alias(c) for c in CLASHES])


def shown(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


SF = "/root/testdata/sf0.001"
