"""Reading chunk documents, lines, catalogues, question lists and configuration, all by Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text


def manual_index(spark: SparkSession, path: str, dataset_id: str | None = None, strict: bool = False) -> DataFrame:
    """Chunks of documents: (dataset_id, creation_date, last_updated, ord, kind, id, title, content, lists of strings).

    kind: chunk if everything an annotated chunk needs is there, text for another object with an id and a content, raw
    for a string. Dates under the editor's names count too, unless strict.
    """
    docs = spark.read.schema(schema.MANUAL_INDEX).option("multiLine", True).json(path)
    date = lambda a, b: F.coalesce(a, F.lit(0)) if strict else F.coalesce(a, b, F.lit(0))
    each = docs.select(
        (F.lit(dataset_id) if dataset_id else F.col("id")).alias("dataset_id"),
        date(F.col("creation_date"), F.col("date_created")).cast("long").alias("creation_date"),
        date(F.col("last_updated"), F.col("last_modified")).cast("long").alias("last_updated"),
        F.posexplode("chunks").alias("ord", "chunk"),
    )
    string = lambda k: F.try_variant_get("chunk", f"$.{k}", "string")
    strings = lambda k: F.try_variant_get("chunk", f"$.{k}", "array<string>")
    found = {k: (strings if k in {"keywords", "negativeKeywords", "relevantChunksIds", "parameters"} else string)(k) for k in schema.CHUNK_KEYS}
    is_string = F.schema_of_variant("chunk") == "STRING"
    whole = F.lit(True)
    for v in found.values():
        whole = whole & v.isNotNull()
    kind = F.when(is_string, "raw").when(whole, "chunk").when(found["id"].isNotNull() & found["content"].isNotNull(), "text")
    columns = {**found, "content": F.when(is_string, F.try_variant_get("chunk", "$", "string")).otherwise(found["content"])}
    return each.select("dataset_id", "creation_date", "last_updated", "ord", kind.alias("kind"), *[v.alias(k) for k, v in columns.items()])


def raw_as_text(chunks: DataFrame, with_id: bool = True) -> DataFrame:
    """Strings become plain texts, with an id that depends on where they stand, or without one."""
    raw = F.col("kind") == "raw"
    own = F.left(F.sha2(F.concat_ws("/", "dataset_id", F.col("ord").cast("string")), 256), F.lit(32)) if with_id else F.lit(None).cast("string")
    return chunks.withColumn("id", F.when(raw, own).otherwise(F.col("id"))).withColumn("kind", F.when(raw, "text").otherwise(F.col("kind")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, text): lines with their numbers from 0, without line ends (LF; a CR stays); no line after a last line end.

    Files are read in splits. What a split's lines stand after is the running sum of the splits' counts, a row a split;
    inside a split, lines are numbered as they are read.
    """
    read = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    sizes = read.groupBy("path", "split").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    upto = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("path", "split", "first", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    return read.join(before, ["path", "split"]).select("path", (F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "text")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(id, source, target, target_state, file, line, broken) of an XLIFF catalogue's units; broken holds what can't be read."""
    unit = "_id string, source string, target struct<_VALUE:string,_state:string>, `context-group` struct<context:array<struct<_VALUE:string,`_context-type`:string>>>, _corrupt_record string"
    rows = spark.read.format("xml").option("rowTag", "trans-unit").option("columnNameOfCorruptRecord", "_corrupt_record").schema(unit).load(path)
    of = lambda kind: F.element_at(F.filter("`context-group`.context", lambda c: c["_context-type"] == kind), 1)["_VALUE"]
    return rows.select(F.col("_id").alias("id"), "source", F.col("target._VALUE").alias("target"), F.col("target._state").alias("target_state"), of("sourcefile").alias("file"), of("linenumber").try_cast("int").alias("line"), F.col("_corrupt_record").alias("broken"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(q_no, question, answer, sources) of a Markdown list of questions with answers and cited sources."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.concat(F.lit("\n"), F.regexp_replace("value", "﻿|\r", "")), r"\n# (?=\d+\. )")).alias("q"))
    part = lambda pattern: text.py_strip(F.regexp_extract("q", pattern, 1))
    q = whole.where(F.col("q").rlike(r"\A\d+\. "))
    return q.select(
        F.regexp_extract("q", r"\A(\d+)\.", 1).cast("int").alias("q_no"),
        part(r"\A\d+\. ([^\n]*)").alias("question"),
        part(r"(?s)\nAntwort:[ \t]*\n(.*?)(?=\nQuellen:|\z)").alias("answer"),
        F.transform(F.regexp_extract_all("q", F.lit(r"(?m)^\[\d+\] ?(.*)$"), 1), text.py_strip).alias("sources"),
    )


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, prompt_no, prompt) of a Markdown list of scenarios, each a heading in brackets with quoted questions."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.concat(F.lit("\n"), F.regexp_replace("value", "\ufeff|\r", "")), r"\n## (?=\[)")).alias("s"))
    of = whole.where(F.startswith("s", F.lit("[")))
    prompts = F.transform(F.regexp_extract_all("s", F.lit(r'(?m)^Frage:[ \t]*\n+"(.*)"[ \t]*$'), 1), text.py_strip)
    return of.select(text.py_strip(F.regexp_extract("s", r"\A\[([^\]]*)\]", 1)).alias("scenario"), F.posexplode(prompts).alias("prompt_no", "prompt"))


def json_map(raw: str, spark: SparkSession) -> DataFrame:
    """(key, value) of a JSON object of strings that aren't blank; anything else is an error."""
    parsed = spark.createDataFrame([(raw,)], "raw string").select(F.from_json("raw", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    each = parsed.select(F.explode("m").alias("key", "value"))
    bad = F.col("value").isNull() | text.is_blank(F.col("value"))
    return each.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("blank value for "), F.col("key")))).otherwise(F.col("value")))


def vector_store(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    """A store, or one data set of it, of which alone the files are read."""
    store = spark.read.parquet(path)
    return store if dataset_id is None else store.where(F.col("dataset_id") == dataset_id)


def decoded(content: DataFrame, column: str) -> DataFrame:
    """Base64 of UTF-8 as text."""
    return content.withColumn(column, F.decode(F.unbase64(column), "UTF-8"))


def power_record(spark: SparkSession, path: str) -> DataFrame:
    """The stored energy of the index, or one row with an error where the file holds none."""
    rows = spark.read.schema(schema.POWER).json(path)
    base = spark.range(1).select(F.lit(1).alias("one"))
    return base.join(rows.limit(1).withColumn("one", F.lit(1)), "one", "left").drop("one").withColumn("error", F.when(F.col("total_kWh").isNull(), "no power data"))


def last_of_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A dictionary from rows: the last value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    own = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")
