"""Editing an ordered list of chunks and plain texts, one document or many at once.

Rows are (doc, ord, kind, id, title, content, relevantChunksIds); kind is chunk or text. Results are numbered anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text


def in_doc() -> WindowSpec:
    return Window.partitionBy("doc").orderBy("ord")


def renumbered(items: DataFrame, *by: str) -> DataFrame:
    return items.withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy(*by)) - 1)


def new_id(*parts: Column) -> Column:
    """An id that depends on where the item stands, so that it is the same each time."""
    return F.left(F.sha2(F.concat_ws("/", *[p.cast("string") for p in parts]), 256), F.lit(32))


def create_chunk(items: DataFrame, selections: DataFrame) -> DataFrame:
    """Cuts the selected code points (doc, id, start, end) out of plain texts: what stands before, the selection as a chunk, what stands after; each trimmed, and blank rests go.

    Only texts are cut, and only where start < end; a blank selection is a chunk nevertheless.
    """
    chosen = selections.select(F.col("doc").alias("of_doc"), F.col("id").alias("of_id"), "start", "end")
    met = items.join(chosen, (F.col("doc") == F.col("of_doc")) & (F.col("id") == F.col("of_id")), "left")
    cut = (F.col("kind") == "text") & (F.col("start") < F.col("end"))
    item = lambda part, kind, c, title: F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), new_id(F.col("id"), F.lit(part)).alias("id"), title.alias("title"), text.js_trim(c).alias("content"), F.array().cast("array<string>").alias("relevantChunksIds"))
    none = F.lit(None).cast("string")
    before = item(0, "text", F.expr("substring(content, 1, cast(start as int))"), none)
    own = item(1, "chunk", F.expr("substring(content, cast(start + 1 as int), cast(end - start as int))"), F.lit(""))
    after = item(2, "text", F.expr("substring(content, cast(end + 1 as int))"), none)
    parts = F.filter(F.array(before, own, after), lambda x: (x["part"] == 1) | (x["content"] != ""))
    as_is = F.array(F.struct(F.lit(0).alias("part"), "kind", "id", "title", "content", "relevantChunksIds"))
    rows = met.select("doc", "ord", F.inline(F.when(F.coalesce(cut, F.lit(False)), parts).otherwise(as_is)))
    return renumbered(rows, "ord", "part").drop("part")


def delete_chunk(items: DataFrame, deleted: DataFrame) -> DataFrame:
    """Turns the chunks (doc, id) into plain text and joins it with the texts right before and after, without a separator; then every blank item of that document goes.

    Only the direct neighbours join: texts that already stood side by side stay apart.
    """
    gone = deleted.select(F.col("doc").alias("of_doc"), F.col("id").alias("of_id"), F.lit(True).alias("deleted"))
    marked = items.join(gone, (F.col("doc") == F.col("of_doc")) & (F.col("id") == F.col("of_id")), "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    near = lambda n: F.coalesce(F.lag("deleted", n).over(in_doc()), F.lit(False))
    joins_before = (F.col("kind") == "text") & near(1) | F.col("deleted") & (F.coalesce(F.lag("kind").over(in_doc()), F.lit("chunk")) == "text")
    island = marked.withColumn("starts", (~joins_before).cast("int")).withColumn("island", F.sum("starts").over(in_doc()))
    whole = island.groupBy("doc", "island").agg(
        F.min("ord").alias("ord"),
        F.when(F.bool_or("deleted"), "text").otherwise(F.min_by("kind", "ord")).alias("kind"),
        F.min_by("id", "ord").alias("id"),
        F.when(~F.bool_or("deleted"), F.min_by("title", "ord")).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "").alias("content"),
        F.when(F.bool_or("deleted"), F.array().cast("array<string>")).otherwise(F.min_by("relevantChunksIds", "ord")).alias("relevantChunksIds"),
    )
    kept = whole.join(deleted.select(F.col("doc").alias("of_doc"), F.lit(True).alias("purged")).distinct(), F.col("doc") == F.col("of_doc"), "left")
    return renumbered(kept.where(F.col("purged").isNull() | (text.js_trim(F.col("content")) != "")), "ord").drop("island", "of_doc", "purged")


def update_property(items: DataFrame, id_: str, name: str, value: Column) -> DataFrame:
    """One property of every item with that id."""
    return items.withColumn(name, F.when(F.col("id") == id_, value).otherwise(F.col(name)))


def add_tag(tags: Column, value: Column, multiple: bool = False) -> Column:
    """Puts a tag at the end, unless it is blank or there already; lists of fixed options don't change."""
    return tags if multiple else F.when((text.js_trim(value) != "") & ~F.array_contains(tags, value), F.array_append(tags, value)).otherwise(tags)


def select_option(tags: Column, value: Column) -> Column:
    return F.when(F.array_contains(tags, value), tags).otherwise(F.array_append(tags, value))


def remove_tag(tags: Column, value: Column) -> Column:
    return F.array_remove(tags, value)


def matching_option(label: Column, value: Column, query: Column, selected: Column) -> Column:
    """Whether an option is offered: its label holds the query in any case, and it isn't selected."""
    return F.contains(F.lower(label), F.lower(query)) & ~F.array_contains(selected, value)


def related_options(items: DataFrame) -> DataFrame:
    """(doc, value, label) of the chunks that another may refer to."""
    return items.where(F.col("kind") == "chunk").select("doc", F.col("id").alias("value"), text.or_else(F.col("title"), F.col("id")).alias("label"))


def other_options(options: Column, id_: Column) -> Column:
    """A chunk's options, an array of (value, label), without itself."""
    return F.filter(options, lambda o: o["value"] != id_)


def option_labels(values: DataFrame, options: DataFrame, key: str = "value") -> DataFrame:
    """values with the label of each, or the value itself where no option has it."""
    of = options.select(F.col("value").alias("of_value"), F.col("label").alias("of_label"))
    return values.join(of, F.col(key) == F.col("of_value"), "left").withColumn("label", F.coalesce("of_label", key)).drop("of_value", "of_label")


def selection_valid(start: Column, end: Column, id_: Column) -> Column:
    return (start != end) & (end > 0) & (start >= 0) & (id_ != "")
