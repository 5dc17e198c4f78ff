"""Groups of equal texts by skew-safe combining, in DataFrame operations only.

Texts are compared whole at every stage. Equal ones meet first inside a task (the partial aggregate), then inside a
salt and a digest, and at last the winners of all salts; so a group of a third of all rows is a row a task in the first
exchange and a row a salt in the second. Texts whose digest nobody shares aren't moved at all: a bitmap of shared
digests, of bounded size, tells them while the table is read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, ROW, ids_name_rows, matched, materialise, numbered, partitions

#: Rows of the bitmap of shared digests, each of 64 bits: the size of what is broadcast, whatever the input.
BITMAP_ROWS = 1 << 17


def _place(digest: str, rows: int) -> tuple[Column, Column]:
    """Where a digest stands in the bitmap: its row and its bit."""
    return F.expr(f"pmod(shiftrightunsigned({digest}, 6), {rows})").alias("place"), F.expr(f"shiftleft(1L, cast({digest} & 63 as int))").alias("bit")


def _bitmap(shared: DataFrame, rows: int) -> DataFrame:
    place, bit = _place("digest", rows)
    return shared.select(place, bit).groupBy("place").agg(F.bit_or("bit").alias("bits"))


def _parted(rows: DataFrame, bitmap: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose digest others may share, and the others."""
    place, bit = _place("digest", n)
    met = rows.select("*", place, bit).join(F.broadcast(bitmap), "place", "left")
    may = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return tuple(met.where(x).drop("place", "bit", "bits") for x in (may, ~may))


def classes(texts: DataFrame, salts: int) -> DataFrame:
    """(digest, text_sha256, keep_id, group_size) of each distinct text of (doc_id, digest, text): keep_id is the largest id that has it.

    Two texts that share both digests can't be told apart by name: they are an error, not a group.
    """
    salted = texts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    in_salt = salted.groupBy("salt", "digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    whole = in_salt.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    named = whole.select("digest", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    once = named.groupBy("digest", "text_sha256").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("n_texts"))
    return once.withColumn("group_size", F.when(F.col("n_texts") > 1, F.raise_error(F.lit("different texts have the same digests"))).otherwise(F.col("group_size"))).drop("n_texts")


def labelled(docs: DataFrame, normal: Callable[[Column], Column] | None = None, digest: Callable[[Column], Column] = F.xxhash64, bitmap_rows: int = BITMAP_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, and ROW where the docs have it.

    Two texts are equal when they are after `normal`, which leaves them as they are unless it is given; null counts as
    empty. Of equal ones the row with the largest doc_id stays. A null id is smaller than all others. Where several rows
    have that id, the last of them by ROW stays, so one of each group stays in any case. Repeated rows are rows of their
    own; other columns don't matter; an empty table gives no rows. A text is held whole in one row, however long.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    own = [ROW] if ROW in docs.columns else []
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), (normal(text) if normal else text).alias("text"), *own)
    texts = texts.withColumn("digest", digest(F.col("text")).cast("long"))
    rows = materialise(texts.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256"), *own))
    shared = materialise(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    bitmap = _bitmap(shared, bitmap_rows)
    salts = math.isqrt(partitions(spark)) + 1
    found = materialise(classes(_parted(texts.select("doc_id", "text", "digest"), bitmap, bitmap_rows)[0], salts))
    several, single = _parted(rows, bitmap, bitmap_rows)
    joined = matched(several, found, ["digest", "text_sha256"], F.col("group_size") * 1000 > rows.count())
    if own:
        last = joined.where("doc_id = keep_id").groupBy("digest", "text_sha256").agg(F.max(ROW).alias("last"), F.max("group_size").alias("of"))
        joined = matched(joined, last, ["digest", "text_sha256"], F.col("of") * 1000 > rows.count()).withColumn("kept", F.col(ROW) == F.col("last"))
    else:
        joined = joined.withColumn("kept", F.col("doc_id") == F.col("keep_id"))
    alone = single.select("*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    id_ = lambda c: F.nullif(c, F.lit(NO_ID)).alias(c)
    columns = [id_("doc_id"), id_("keep_id"), "group_size", "kept", "text_sha256", *own]
    return joined.select(*columns).unionByName(alone.select(*columns))


def deduplicate(docs: DataFrame, normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """labelled() for any docs: rows are numbered first where ids don't tell them apart."""
    return labelled(docs.drop(ROW) if ids_name_rows(docs) else numbered(docs), normal).drop(ROW)


def unique(docs: DataFrame, normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    plain = ids_name_rows(docs)
    own = docs if plain else numbered(docs)
    key = "doc_id" if plain else ROW
    gone = labelled(own, normal).where(~F.col("kept")).select(F.col(key).alias("_gone"))
    return own.join(gone, own[key] == F.col("_gone"), "left_anti").select(*[own[c] for c in docs.columns])
