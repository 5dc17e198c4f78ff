"""Writing stores, chunk files, documents, frames and tracking rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import chunk_files


def vector_store(store: DataFrame, path: str) -> None:
    """Replaces the data sets that `store` holds, and no others."""
    store.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def split_chunks(chunks: DataFrame, path: str) -> int:
    """Writes <id>.json for each chunk, the last of those that share an id; ones without a title or an id are left out. Other files in the folder stay. Returns how many chunks there were to write, repeated ids and all, as the tasks that wrote them counted."""
    usable = chunks.where(F.col("title").isNotNull() & (F.coalesce("id", F.lit("")) != "") & (F.col("kind") != "raw"))
    own = [c for c in usable.columns if c not in {"id", "ord", "kind", "dataset_id"}]
    last = usable.groupBy("id").agg(F.max_by(F.struct(*own), "ord").alias("r"), F.count("*").alias("_n"))
    chunk_files.register(chunks.sparkSession)
    last.select("id", "r.*", "_n").write.format("chunk_files").option("weight", "_n").mode("append").save(path)
    return chunk_files.rows_written(path)


def document(chunks: DataFrame) -> DataFrame:
    """(dataset_id, value): each data set as one JSON text with its chunks in order."""
    columns = [c for c in chunks.columns if c not in {"dataset_id", "ord"}]
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.struct(*columns).alias("chunk"))))
    return chunks.groupBy("dataset_id").agg(F.to_json(F.struct(F.transform(ordered, lambda x: x["chunk"]).alias("chunks")), {"pretty": "true"}).alias("value"))


def json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def power_record(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)


def encoded(content: DataFrame, column: str) -> DataFrame:
    return content.withColumn(column, text.base64(F.col(column)))


def tracking(rows: DataFrame, path: str, site: str | None, token: str | None, url: str | None) -> bool:
    """Appends tracking rows; without a site, a token and an address there is no tracking."""
    if not (site and token and url):
        return False
    rows.write.mode("append").parquet(path)
    return True
