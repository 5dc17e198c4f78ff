"""A corpus pipeline of four stages: language identification, near-duplicate removal, removal of repeated passages, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of `documents`, and returns a DataFrame. Its result
is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, language_id, packing, suffix_dedup
from lodestone.llm.common import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents with a score below this, or without letters, are in no language that the labelled rows hold.
LEAST_SCORE = 0.1


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language of the labelled ones, learnt from the table's own rows with a lang; the rest goes."""
    return language_id.keep_identified(docs, language_id.fit(docs.select("text", "lang")), LEAST_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard coefficient of 0.8 or more of five-word shingles."""
    return jaccard_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of the texts every string of 100 bytes or more that stood earlier; documents of which nothing is left go."""
    return suffix_dedup.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language identification", identified),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs


#: Tokens and language models are beyond SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None
