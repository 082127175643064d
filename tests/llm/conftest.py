"""Small tables with nulls, empty and long texts, repeated rows and clashing names."""

import pytest
from pyspark.sql import functions as F

from corpuslens.session import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    return " ".join("".join(chr(97 + (seed * 7919 + i * i * 31 + j * (seed + i)) % 26) for j in range(3 + (i + seed) % 6)) for i in range(n))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    long_text = words(5, 30_000)
    passage = words(99, 80)
    rows = [
        (1, words(1, 120), "en", "a", 1), (2, words(1, 120), "en", "a", 1), (2, words(1, 120), "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0),
        (None, words(2, 90), None, "b", 5), (5, "  \t\n ", "en", "b", 5), (6, long_text, "en", "c", 7), (7, words(7, 60) + " " + passage + " " + words(8, 60), "fr", "c", 8),
        (8, words(9, 60) + "\n" + passage + "\n" + words(10, 60), "fr", "c", 8), (9, "é" * 300, "fr", "d", 300), (10, "word", "en", "d", 4), (11, "ab " * 200, "en", "d", 600),
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("words", F.lit("clash")).withColumn("_n_words", F.lit(1)).withColumn("kept", F.lit("x")).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
