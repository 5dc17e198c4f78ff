"""Connected components of an edge list by alternating stars, each round two joins; no node's neighbours are ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "of")
    return both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(least.withColumnRenamed("a", "of"), F.col("a") == F.col("of")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.unionByName(least.withColumnRenamed("m", "b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b): component is the smallest node reachable. Loops and repeated edges don't matter; nodes without another don't appear."""
    now = materialise(edges.where("a <> b").select("a", "b").distinct())
    seen = None
    while True:
        now = materialise(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
