"""Prompts from admitted chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def context(admitted: DataFrame, order_from_source: bool = False) -> DataFrame:
    """(query_id, context) from rows (query_id, rank, at, position, title, content), in order of retrieval or of position."""
    keys = ["position", "rank", "at"] if order_from_source else ["rank", "at"]
    piece = F.concat(F.lit("Titel: "), F.col("title"), F.lit(" \n"), F.col("content"), F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct(*keys, piece.alias("piece"))))
    return admitted.groupBy("query_id").agg(text.py_strip(F.array_join(F.transform(ordered, lambda x: x["piece"]), "")).alias("context"))


def render(requests: DataFrame, templates: dict[str, str], default: str | None = None) -> DataFrame:
    """requests (dataset_id, prompt, context) with the data set's template filled in; a data set without one takes the default, or gives null."""
    filled = {k: text.fill_template(v, F.coalesce("context", F.lit("")), F.col("prompt")) for k, v in templates.items()}
    out = filled[default] if default else F.lit(None).cast("string")
    for k, v in filled.items():
        out = F.when(F.col("dataset_id") == k, v).otherwise(out)
    return requests.withColumn("rendered", out)
