"""Checks of configuration, requests and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inconsistent(datasets: DataFrame, prompts: DataFrame, key: str = "dataset_id") -> DataFrame:
    """(key, missing): what only one of two configurations names."""
    a, b = datasets.select(key), prompts.select(key)
    return a.exceptAll(b).distinct().join(b, key, "left_anti").withColumn("missing", F.lit("prompt")).unionByName(b.distinct().join(a, key, "left_anti").withColumn("missing", F.lit("dataset")))


def request_valid(prompt: Column, dataset: Column) -> Column:
    return F.length(prompt).between(1, 500) & F.length(dataset).between(1, 500)


def is_manual_chunk(c: Column) -> Column:
    """Whether a variant is an annotated chunk: an id, a title, a content and lists of strings."""
    lists = [F.forall(F.try_variant_get(c, f"$.{k}", "array<string>"), lambda x: x.isNotNull()) for k in ("keywords", "negativeKeywords", "relevantChunksIds", "parameters")]
    texts = [F.try_variant_get(c, f"$.{k}", "string").isNotNull() for k in ("id", "title", "content")]
    ok = F.lit(True)
    for x in (*texts, *lists):
        ok = ok & F.coalesce(x, F.lit(False))
    return ok


def is_text_item(c: Column) -> Column:
    return F.try_variant_get(c, "$.id", "string").isNotNull() & F.try_variant_get(c, "$.content", "string").isNotNull()


def is_manual_index(c: Column) -> Column:
    """Whether a variant is a document: an id, dates that are numbers if they are there, and a list of strings, texts and chunks."""
    chunks = F.try_variant_get(c, "$.chunks", "array<variant>")
    ok = F.try_variant_get(c, "$.id", "string").isNotNull() & F.forall(chunks, lambda x: F.coalesce((F.schema_of_variant(x) == "STRING") | is_text_item(x), F.lit(False)))
    for k in ("date_created", "last_modified"):
        ok = ok & (F.try_variant_get(c, f"$.{k}", "variant").isNull() | F.try_variant_get(c, f"$.{k}", "double").isNotNull())
    return F.coalesce(ok, F.lit(False))


def require_services(hosts: dict[str, str | None], models: dict[str, list[str]]) -> None:
    """An error for the first host that isn't named, or kind of model of which none is."""
    for name, host in hosts.items():
        if not host:
            raise ValueError(f"{name} is required")
    for kind, names in models.items():
        if not [n for n in names if n]:
            raise ValueError(f"at least one {kind} model is required")
