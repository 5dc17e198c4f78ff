"""The graph of chunks that refer to one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers


def _related(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").alias("src"), F.col("title").alias("src_title"), F.explode("relevantChunksIds").alias("related"))


def nodes_by_title(chunks: DataFrame) -> DataFrame:
    """One node a title, coloured by it and sized by the content of the first chunk that has it."""
    first = chunks.groupBy("title").agg(F.coalesce(F.min_by(F.length("content"), "ord"), F.lit(0)).alias("content_length"))
    return first.withColumn("color", numbers.node_color(F.col("title"))).withColumn("size", numbers.node_size(F.col("content_length")))


def nodes_by_id(chunks: DataFrame) -> DataFrame:
    """One node an id, with the title of its last chunk."""
    last = chunks.groupBy("id").agg(F.max_by("title", "ord").alias("title"))
    return last.withColumn("color", numbers.node_color(F.col("title")))


def edges_by_title(chunks: DataFrame) -> DataFrame:
    """Distinct edges between titles; of chunks that share an id the last names the target, and an empty title is none."""
    target = chunks.groupBy(F.col("id").alias("related")).agg(F.max_by("title", "ord").alias("dst_title")).where("dst_title <> ''")
    edges = _related(chunks).join(target, "related").select("src_title", "dst_title").distinct()
    return edges.withColumn("color", numbers.node_color(F.col("src_title")))


def edges_by_id(chunks: DataFrame) -> DataFrame:
    known = chunks.select(F.col("id").alias("related")).distinct()
    return _related(chunks).join(known, "related").select("src", F.col("related").alias("dst")).distinct().withColumn("color", F.lit("black"))


def enrich(chunks: DataFrame) -> DataFrame:
    """content_length, content_plus_length (with the lengths of all related chunks, repeats and all, unknown ones 0) and relevantChunksIdsNum.

    A content_length that chunks bring counts for those that refer to them; their own is always that of the content.
    """
    measures = ("content_length", "content_plus_length", "relevantChunksIdsNum")
    stored = F.coalesce("content_length", F.length("content")) if "content_length" in chunks.columns else F.length("content")
    length = chunks.groupBy(F.col("id").alias("related")).agg(F.max_by(stored, "ord").alias("related_length"))
    more = chunks.select("ord", F.explode("relevantChunksIds").alias("related")).join(length, "related").groupBy(F.col("ord").alias("o")).agg(F.sum("related_length").alias("more"))
    own = F.length("content")
    joined = chunks.join(more, F.col("ord") == F.col("o"), "left")
    return joined.select(*[c for c in chunks.columns if c not in measures], own.alias("content_length"), (own + F.coalesce("more", F.lit(0))).alias("content_plus_length"), F.size("relevantChunksIds").alias("relevantChunksIdsNum"))


def incoming(chunks: DataFrame) -> DataFrame:
    """(id, n_incoming): how many chunks refer to each chunk."""
    n = _related(chunks).select("src", "related").distinct().groupBy("related").agg(F.count("*").alias("n"))
    return chunks.select("id").distinct().join(n, F.col("id") == F.col("related"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n_incoming"))


def degrees(edges: DataFrame) -> DataFrame:
    """An extension: edges out of and into each node."""
    out = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    return out.unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def size_metrics(enriched: DataFrame) -> DataFrame:
    """Node sizes by each measure that the display offers."""
    measures = {"content_length": 100.0, "content_plus_length": 500.0, "relevantChunksIdsNum": 0.5}
    long = enriched.select("id", *measures).unpivot(["id"], list(measures), "measure", "amount")
    factor = F.create_map(*[x for k, v in measures.items() for x in (F.lit(k), F.lit(v))])
    return long.select("id", "measure", (F.lit(10.0) + F.col("amount") / F.element_at(factor, F.col("measure"))).alias("size"))
