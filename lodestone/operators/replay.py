"""Replaying a log of edits on documents of ordered items.

Each action meets the document as the one before left it. Items and actions of a document come to one task in order and
are folded as they stream by: only the document as it stands is held, however long its log. What replay() returns is
a snapshot; a later log continues from it with the same result as the whole log from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text

#: An item: a chunk has a title and all lists, anything less is a plain text.
LISTS = ("keywords", "negativeKeywords", "relevantChunksIds", "parameters")
ITEM = {"id": "string", "title": "string", "content": "string", **dict.fromkeys(LISTS, "array<string>")}
FIELDS = tuple(ITEM)
#: What an action may need: create (id, start, end), delete (id), update (id, property, value or values), set (items); others change no item.
ACTION = {"action": "string", "id": "string", "start": "long", "end": "long", "property": "string", "value": "string", "values": "array<string>", "items": f"array<struct<{', '.join(f'{k}: {v}' for k, v in ITEM.items())}>>"}


def complete(items: DataFrame) -> DataFrame:
    """Items (doc, ord, kind, id, title, content, ...) with all of FIELDS: lists that a chunk lacks are empty, a text has none."""
    is_chunk = F.col("kind") == "chunk"
    held = lambda c: F.col(c) if c in items.columns else F.lit(None)
    lists = [F.when(is_chunk, F.coalesce(held(c), F.array().cast("array<string>"))).alias(c) for c in LISTS]
    return items.select("doc", "ord", "id", F.when(is_chunk, F.coalesce(held("title"), F.lit(""))).alias("title"), F.coalesce("content", F.lit("")).alias("content"), *lists)


def new_id(doc: Any, seq: int, part: int) -> str:
    """The id of an item that an action makes: it depends on the action alone, so that later actions can name it."""
    return hashlib.sha256(f"{doc}/{seq}/{part}".encode()).hexdigest()[:32]


def _is_text(item: dict) -> bool:
    return item["title"] is None or any(item[c] is None for c in LISTS)


def _text(id_: str, content: str) -> dict:
    return {**dict.fromkeys(FIELDS), "id": id_, "content": content}


def _create(items: list[dict], doc: Any, a: dict) -> list[dict]:
    at = next((i for i, x in enumerate(items) if x["id"] == a["id"]), None)
    start, end = a["start"], a["end"]
    if not a["id"] or start is None or end is None or start >= end or at is None or not _is_text(items[at]):
        return items
    content = items[at]["content"]
    before, own, after = (x.strip(text.JS_CHARS) for x in (content[:start], content[start:end], content[end:]))
    made = [(0, _text("", before))] if before else []
    made.append((1, {**_text("", own), "title": "", **{c: [] for c in LISTS}}))
    made += [(2, _text("", after))] if after else []
    return [*items[:at], *({**x, "id": new_id(doc, a["seq"], part)} for part, x in made), *items[at + 1 :]]


def _delete(items: list[dict], doc: Any, a: dict) -> list[dict]:
    if not a["id"]:
        return items
    out: list[dict] = []
    rest, part = iter([*items, None]), 0
    item = next(rest)
    while item is not None:
        following = next(rest)
        if item["id"] != a["id"]:
            out.append(item)
        else:
            if out and _is_text(out[-1]):
                out[-1] = {**out[-1], "content": out[-1]["content"] + item["content"]}
            else:
                out.append(_text(new_id(doc, a["seq"], part), item["content"]))
                part += 1
            if following is not None and _is_text(following):
                out[-1]["content"] += following["content"]
                following = next(rest)
        item = following
    return [x for x in out if x["content"].strip(text.JS_CHARS)]


def _update(items: list[dict], _: Any, a: dict) -> list[dict]:
    name = a["property"]
    if name not in FIELDS:
        return items
    value = a["values"] if name in LISTS else (a["value"] or "") if name == "content" else a["value"]
    return [{**x, name: value} if x["id"] == a["id"] else x for x in items]


def _set(_: list[dict], __: Any, a: dict) -> list[dict]:
    return [{**x, "content": x["content"] or ""} for x in a["items"] or [] if x is not None]


ACTIONS = {"create": _create, "delete": _delete, "update": _update, "set": _set}


def replay(items: DataFrame, log: DataFrame) -> DataFrame:
    """(doc, ord, kind, ITEM) after the actions (doc, seq, ACTION) of the log on the items (doc, ord, ITEM), in the order of seq.

    create cuts start to end (code points; negative ones count from the end) out of the first item of that id, if that
    is a text: what stands before, the selection as a chunk, what stands after, each trimmed; blank rests go, a blank
    selection stays. delete makes text of every item of that id and joins it with the texts right before and after; then
    blank items of the document go, whether an item was met or not. update puts a property of every item of that id; a
    chunk without its title or a list is a text. set replaces all items, also of a document that has none yet. An empty
    or null id, an unknown action or property change nothing. A document without items left has no rows. Items made by
    an action have new_id(doc, seq, 0, 1 or 2). Actions of equal seq count in the order of action and id.
    """
    none = lambda types, of="": [F.lit(None).cast(t).alias(of + c) for c, t in types.items()]
    own = items.select("doc", F.lit(0).alias("phase"), F.col("ord").cast("long").alias("place"), *FIELDS, *none(ACTION, "_"))
    given = [(F.col(c) if c in log.columns else F.lit(None)).cast(t).alias(f"_{c}") for c, t in ACTION.items()]
    acts = log.select("doc", F.lit(1).alias("phase"), F.col("seq").cast("long").alias("place"), *none(ITEM), *given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        doc, out, begun = None, [], False

        def finished() -> Iterator[dict]:
            for n, x in enumerate(held):
                yield {"doc": doc, "ord": n, "kind": "text" if _is_text(x) else "chunk", **x}

        for b in batches:
            for row in b.to_pylist():
                if not begun or row["doc"] != doc:
                    out.extend(finished())
                    doc, held, begun = row["doc"], [], True
                if not row["phase"]:
                    held.append({c: row[c] for c in FIELDS} | {"content": row["content"] or ""})
                elif row["_action"] in ACTIONS:
                    held = ACTIONS[row["_action"]](held, doc, {"seq": row["place"], **{c: row[f"_{c}"] for c in ACTION}})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if begun and (out := list(finished())):
            yield pa.RecordBatch.from_pylist(out, schema)

    result = f"doc {items.schema['doc'].dataType.simpleString()}, ord int, kind string, {', '.join(f'{k} {v}' for k, v in ITEM.items())}"
    schema = to_arrow_schema(StructType.fromDDL(result))
    ordered = own.unionByName(acts).repartition("doc").sortWithinPartitions("doc", "phase", "place", "_action", "_id")
    return ordered.mapInArrow(run, result)


def selections(log: DataFrame) -> DataFrame:
    """(doc, id, start, end) last selected in each document by a select action."""
    chosen = log.where(F.col("action") == "select")
    return chosen.groupBy("doc").agg(F.max_by(F.struct("id", "start", "end"), "seq").alias("s")).select("doc", "s.*")
