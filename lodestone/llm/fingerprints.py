"""Threshold-scaled sketches of documents, in DataFrame operations only.

A sketch keeps every hash of a five-word shingle that lies below a fixed fraction of all hashes. What is kept depends
on the shingle alone: sketches of parts merge by union, and the share of the smaller sketch that the larger one holds
estimates containment, however unequal the documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, materialise, texts

SPACES = r"[\x20\x09-\x0D]+"


def with_sketch(rows: DataFrame, text: str, name: str, width: int = 5, scale: int = 5) -> DataFrame:
    """Adds the sketch of a text column: the sorted distinct hashes of its shingles below 1/scale of all, whatever its length.

    A text of fewer words is one shingle. A sketch of which no hash lies below, or of a text without words, is empty.
    """
    words, hashes = f"{name}_words", f"{name}_hashes"
    below = -(1 << 63) + (1 << 64) // scale
    rows = rows.withColumn(words, F.array_remove(F.split(text, SPACES), ""))
    shingle = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))
    rows = rows.withColumn(hashes, F.slice(shingle, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1))))
    return rows.withColumn(name, F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(below))))).drop(words, hashes)


def containment(a: Column, b: Column, same: Column | bool = False) -> Column:
    """The share of the smaller sketch that the other holds. An empty sketch tells nothing: then it is 1 where the texts are the same, else 0."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).when(F.lit(same) if isinstance(same, bool) else same, F.lit(1.0)).otherwise(F.lit(0.0))


def as_text(sketch: Column) -> Column:
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, key, n_chars) and the next row's doc_id and key in ascending order, after the last the first: ids are dealt by range, numbered inside each range, and ranges meet through their first rows alone."""
    dealt = materialise(ids.repartitionByRange("doc_id", "key").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy("doc_id", "key")
    led = dealt.withColumn("next", F.lead(F.struct("doc_id", "key")).over(own))
    # One row a range: their number is that of partitions, not of documents.
    firsts = dealt.groupBy("part").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    everywhere = firsts.agg(F.array_sort(F.collect_list(F.struct("part", "first"))).alias("firsts"))
    after = F.coalesce(F.get(F.filter("firsts", lambda x: x["part"] > F.col("part")), F.lit(0)), F.get("firsts", F.lit(0)))
    return led.join(F.broadcast(everywhere)).select("doc_id", "key", "n_chars", F.coalesce("next", after["first"]).alias("next"))


def fingerprint(docs: DataFrame, width: int = 5, scale: int = 5) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row's whole text.

    Edited text: the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document
    by (doc_id, then a hash of the text), after the last the first. A null text is empty. Rows that repeat both id and
    text count once; null ids come first. A single document is its own successor. Texts whose sketches are empty, as some
    short ones' are, are alike only where they are the same.
    """
    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("key", F.xxhash64("text"))
    joins = lambda a, b: (F.col(f"{a}doc_id") == F.col(f"{b}doc_id")) & (F.col(f"{a}key") == F.col(f"{b}key"))
    # One exchange of the texts serves both joins.
    held = with_sketch(rows, "text", "sketch", width, scale).groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch"))
    order = successors(rows.select("doc_id", "key", F.length("text").alias("n_chars")).distinct())
    wanted = order.select(F.col("doc_id").alias("for_doc_id"), F.col("key").alias("for_key"), F.col("next.doc_id").alias("next_doc_id"), F.col("next.key").alias("next_key"), F.floor(F.col("n_chars") / 4).cast("int").alias("n_replaced"))
    given = held.join(wanted, joins("", "next_")).select("for_doc_id", "for_key", "next_key", F.expr("substring(text, 1, n_replaced)").alias("given"), F.col("sketch").alias("next_sketch"))
    both = held.join(given, joins("", "for_")).withColumn("n_chars", F.length("text").cast("long"))
    edited = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 4) as int)), given)"))
    out = with_sketch(edited, "edited", "edited_sketch", width, scale)
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch"), F.col("key") == F.col("next_key")).alias("near_next"),
    )
