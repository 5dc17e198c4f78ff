"""Licence scans by diagonal voting, in DataFrame operations only.

Every pair of consecutive words is joined to the places where licence templates hold the same pair. A hit votes for
the diagonal (place in the document less place in the template). Votes are gathered by document, template and
diagonal; diagonals that lie next to each other, as words put in or left out make them, merge; a merged span counts
if its words cover enough of the template within little more than the template's length. A base phrase stands where
all its pairs vote for one diagonal, which is the same as its words standing there consecutively.

Templates are a fixed, short list, so that side is broadcast whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

#: Fixed values of the contract: phrase, label.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Wordings of well-known licences that name or open them.
TEMPLATES = [
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the gnu general public license version", "gpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("eclipse public license", "epl"),
    ("boost software license version 1 0", "bsl-1.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons attribution 4 0 international", "cc-by-4.0"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons zero", "cc0"),
]
#: Pairs of these alone say nothing about a licence and don't vote.
FUNCTION_WORDS = {"a", "and", "any", "are", "by", "for", "in", "is", "of", "or", "that", "the", "this", "to", "with", "you"}

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_pairs() -> list[tuple[int, str, bool, int, int, int, int, str, str]]:
    """(template, label, base, words, votes, place, the place's bit, first word, second word) of each voting pair."""
    out = []
    for t, (phrase, label, base) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in TEMPLATES]):
        words = phrase.split()
        pairs = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False)) if base or not {a, b} <= FUNCTION_WORDS]
        out += [(t, label, base, len(words), len(pairs), i, 1 << i, a, b) for i, a, b in pairs]
    return out


def scan(docs: DataFrame, least_cover: float = 0.8, max_shift: int = 2, max_stretch: float = 1.3) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row's whole text.

    score: the best cover of a template among the spans that count, else 0. A null text is empty: 0 words, no labels.
    Rows that repeat both id and text give one row; rows that share an id alone are kept apart.
    """
    spark = docs.sparkSession
    pairs = spark.createDataFrame(template_pairs(), "template int, label string, base boolean, n_template int, n_votes int, place int, vote long, first string, second string").withColumn("hash", F.xxhash64("first", "second"))
    # The Kelvin sign is the one character beyond A-Z that lower() turns into an ASCII letter.
    lowered = F.lower(F.replace("text", F.lit("\u212a"), F.lit("\u0138")))
    words = texts(docs).select("doc_id", F.xxhash64("text").alias("key"), F.array_remove(F.split(lowered, WORD_GAP), "").alias("words"))
    each = words.select("doc_id", "key", F.inline_outer(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("a"), F.get("words", i + 1).alias("b")))))
    hit = (F.xxhash64("a", "b") == F.col("hash")) & (F.col("a") == F.col("first")) & (F.col("b") == F.col("second"))
    # The last word of each document (or its empty row) stays as well, for the number of words.
    votes = each.join(F.broadcast(pairs), hit, "left").where(F.col("template").isNotNull() | F.col("b").isNull())
    by_doc = votes.repartition("doc_id", "key")
    diagonals = by_doc.withColumn("diagonal", F.col("at") - F.col("place")).groupBy("doc_id", "key", "template", "label", "base", "n_template", "n_votes", "diagonal").agg(
        F.max(F.when(F.col("template").isNull(), F.coalesce(F.col("at") + 1, F.lit(0)))).alias("n_words"),
        F.bit_or("vote").alias("voted"),
        F.min("at").alias("from_word"),
        F.max(F.col("at") + 2).alias("to_word"),
    )
    of_template = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(of_template) > max_shift, F.lit(False))
    numbered = diagonals.withColumn("far", far.cast("int")).withColumn("span", F.sum("far").over(of_template))
    spans = numbered.groupBy("doc_id", "key", "template", "label", "base", "n_template", "n_votes", "span").agg(
        F.max("n_words").alias("n_words"),
        F.bit_or("voted").alias("voted"),
        F.min("from_word").alias("from_word"),
        F.max("to_word").alias("to_word"),
        F.count_if(F.bit_count("voted") == F.col("n_votes")).alias("whole"),
        F.min(F.when(F.bit_count("voted") == F.col("n_votes"), F.col("diagonal"))).alias("first_whole"),
        F.max(F.when(F.bit_count("voted") == F.col("n_votes"), F.col("diagonal"))).alias("last_whole"),
    )
    cover = F.bit_count("voted") / F.col("n_votes")
    near = F.col("to_word") - F.col("from_word") <= F.ceil(F.col("n_template") * max_stretch)
    is_base = F.col("base") & (F.col("whole") > 0)
    counts = is_base | (~F.col("base") & ((F.col("whole") > 0) | (near & (cover >= least_cover))))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("doc_id", "key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.when(F.col("base"), F.col("whole")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_whole"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("last_whole"))).cast("long").alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"),
        joined(F.when(counts, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(counts, F.when(F.col("whole") > 0, F.lit(1.0)).otherwise(cover))), F.lit(0.0)).alias("score"),
    ).drop("key")
