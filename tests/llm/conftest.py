"""Small tables with what operators must stand: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = ["the", "of", "Licence", "mit", "license", "apache", "gnu", "general", "public", "cc", "by", "naïve", "ÉTÉ", "straße", "a", "x1", "日本", "and,", "end."]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    random.seed(seed)
    rows = []
    for i in range(n):
        text = " ".join(random.choices(WORDS, k=random.choice([0, 1, 2, 3, 8, 40, 200])))
        rows.append((i, text, random.choice(["en", "de", None]), "s", len(text)))
    long = " ".join(random.choices(WORDS, k=6000))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \n\t ", "en", "s", 4), (n + 3, long, "en", "s", len(long)), (n + 4, "x" * 5000, "en", "s", 5000)]
    for k, (i, t) in enumerate([(r[0], r[1]) for r in rows if r[1] and len(r[1]) > 300][:6]):
        rows.append((n + 10 + 2 * k, t, "en", "s", len(t)))  # a copy
        words = t.split(" ")
        words[len(words) // 2] = f"edit{i}"
        rows.append((n + 11 + 2 * k, " ".join(words), "en", "s", None))  # a near copy
    return rows


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="session")
def clashing(docs: DataFrame) -> DataFrame:
    """With columns of names that operators use inside."""
    names = ["key", "copy", "n", "words", "size", "rep", "set", "component", "around", "found", "at", "label", "template", "sketch", "edits", "word", "class", "rank", "learn"]
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(names)})


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
