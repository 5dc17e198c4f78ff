"""Building a vector store from chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vector
from . import embed


#: Places of a data set that one task numbers.
BLOCK = 100_000


def indexable(chunks: DataFrame) -> DataFrame:
    """Annotated chunks whose content isn't blank."""
    return chunks.where((F.col("kind") == "chunk") & ~text.is_blank(F.col("content")))


def numbered(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """position: the place in the data set by ord, from 0, whatever the file said.

    A data set is numbered in blocks of ord, each by itself: what stands before a block is the running sum of the blocks'
    counts, a row a block. ord numbers the chunks of a file, so blocks are about even; a null comes first.
    """
    of = F.coalesce(F.floor(F.col("ord") / block), F.lit(-(1 << 62))).alias("block")
    sizes = chunks.select(F.col("dataset_id").alias("of_dataset"), of).groupBy("of_dataset", "block").agg(F.count("*").alias("size"))
    upto = Window.partitionBy("of_dataset").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("of_dataset", F.col("block").alias("of_block"), F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    met = chunks.withColumn("block", of).join(before, F.col("dataset_id").eqNullSafe(F.col("of_dataset")) & (F.col("block") == F.col("of_block")))
    inside = F.row_number().over(Window.partitionBy("dataset_id", "block").orderBy("ord"))
    return met.withColumn("position", (F.col("before") + inside - 1).cast("int")).drop("block", "of_block", "of_dataset", "before")


def valid_related(chunks: DataFrame) -> DataFrame:
    """relevantChunksIds without ids that the data set lacks, in order, repeats and all. The ids travel by a join, so a data set may be large."""
    keys = [F.col("dataset_id").alias("of_dataset"), F.col("id").alias("of_id")]
    each = chunks.select("dataset_id", "ord", F.posexplode("relevantChunksIds").alias("at", "related"))
    known = chunks.select(*keys).distinct()
    good = each.join(known, (F.col("dataset_id") == F.col("of_dataset")) & (F.col("related") == F.col("of_id")), "left_semi")
    lists = good.groupBy(F.col("dataset_id").alias("d"), F.col("ord").alias("o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "related"))), lambda x: x["related"]).alias("good"))
    joined = chunks.join(lists, (F.col("dataset_id") == F.col("d")) & (F.col("ord") == F.col("o")), "left")
    return joined.withColumn("relevantChunksIds", F.coalesce("good", F.array().cast("array<string>"))).drop("good", "d", "o")


def build(chunks: DataFrame, count: Callable[[Column], Column] = text.approx_tokens) -> DataFrame:
    """The store's rows, from chunks with (dataset_id, ord, kind, ..., vector): filtered, cross-references cleaned, numbered, with token counts and norms worked out once.

    A data set has one chunk for each ord. References and numbers are worked out on ids alone; contents and vectors move
    once, to meet them.
    """
    usable = indexable(chunks)
    narrow = numbered(valid_related(usable.select("dataset_id", "ord", "id", "relevantChunksIds")))
    found = narrow.select(F.col("dataset_id").alias("d"), F.col("ord").alias("o"), "relevantChunksIds", "position")
    kept = usable.drop("relevantChunksIds").join(found, F.col("dataset_id").eqNullSafe(F.col("d")) & F.col("ord").eqNullSafe(F.col("o"))).drop("d", "o")
    return kept.withColumn("num_tokens", count(F.col("content"))).withColumn("norm", vector.norm(F.col("vector"))).drop("kind", "ord")


def build_with(chunks: DataFrame, load: Callable[[], embed.Embedder], name: str, size: int = 10, count: Callable[[Column], Column] = text.approx_tokens) -> DataFrame:
    """build() of chunks without vectors: a model (see embed.embedded) makes those of the chunks that are indexed, and no others. seconds: what the calls took."""
    return build(embed.embedded(indexable(chunks), load, name, "passage", size), count)


def batches(chunks: DataFrame, size: int = 10) -> DataFrame:
    """The number of the embedding call that each chunk goes into."""
    return numbered(chunks).withColumn("batch", F.floor(F.col("position") / size)).drop("position")


def to_create(requested: DataFrame, store: DataFrame, force: bool = False) -> DataFrame:
    """Requested data sets that have to be built."""
    return requested if force else requested.join(store.select("dataset_id").distinct(), "dataset_id", "left_anti")


def datasets(store: DataFrame) -> DataFrame:
    return store.select("dataset_id").distinct()
