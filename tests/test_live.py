"""Logs of edits, anchored windows, steps and totals: batch against plain Python, streams against the batch."""

from __future__ import annotations

import random
from collections.abc import Callable
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import replay, response
from lodestone.streaming import operators as streaming

T0 = datetime(2024, 1, 1)
LOG = "doc long, seq long, action string, id string, start long, end long, property string, value string, values array<string>"


def doc(*items: tuple) -> list[tuple]:
    return [(1, n, k, i, "" if k == "chunk" else None, c) for n, (k, i, c) in enumerate(items)]


def replayed(spark: SparkSession, items: list[tuple], log: list[tuple]) -> list[tuple]:
    own = replay.complete(spark.createDataFrame(items, "doc long, ord int, kind string, id string, title string, content string"))
    acts = spark.createDataFrame([(1, n, *a, *[None] * (7 - len(a))) for n, a in enumerate(log)], LOG)
    return [(r["kind"], r["id"], r["title"], r["content"]) for r in replay.replay(own, acts).orderBy("doc", "ord").collect()]


def test_actions_meet_what_the_last_one_left(spark: SparkSession) -> None:
    made = replay.new_id(1, 0, 1)
    log = [("create", "t", 6, 9), ("update", made, None, None, "title", "B"), ("create", replay.new_id(1, 0, 2), 0, 3), ("delete", replay.new_id(1, 2, 1))]
    got = replayed(spark, doc(("text", "t", "hello big world")), log)
    assert got == [("text", replay.new_id(1, 0, 0), None, "hello"), ("chunk", made, "B", "big"), ("text", replay.new_id(1, 3, 0), None, "world")]


@pytest.mark.parametrize(
    ("items", "action", "expected"),
    [
        ([("text", "a", "x"), ("text", "b", "y"), ("chunk", "c", "z"), ("text", "d", "w"), ("text", "e", "v")], ("delete", "c"), ["x", "yzw", "v"]),
        ([("chunk", "c", "1"), ("chunk", "c", "2"), ("text", "d", "3"), ("text", "c", "4")], ("delete", "c"), ["1234"]),
        ([("text", "c", "1"), ("text", "c", "2"), ("chunk", "k", " ")], ("delete", "c"), ["12"]),
        ([("text", "a", " \n"), ("chunk", "b", "k"), ("text", "c", "﻿")], ("delete", "nothing"), ["k"]),
        ([("text", "a", " "), ("chunk", "b", "k")], ("delete", ""), [" ", "k"]),
        ([("text", "a", "abcdef")], ("create", "a", -4, -1), ["ab", "cde", "f"]),
        ([("text", "a", "ab   ")], ("create", "a", 2, 99), ["ab", ""]),
        ([("text", "a", "abc")], ("create", "a", 2, 2), ["abc"]),
        ([("text", "a", "abc")], ("create", "a", None, 2), ["abc"]),
        ([("chunk", "a", "abc"), ("text", "a", "abc")], ("create", "a", 0, 2), ["abc", "abc"]),
        ([("text", "a", "abc")], ("update", "a", None, None, "content", None), [""]),
        ([("text", "a", "abc")], ("unheard of", "a"), ["abc"]),
        ([("text", "a", "abc")], (None, None), ["abc"]),
    ],
)
def test_single_actions(spark: SparkSession, items: list, action: tuple, expected: list[str]) -> None:
    assert [r[3] for r in replayed(spark, doc(*items), [action])] == expected


def test_a_chunk_without_its_title_is_a_text(spark: SparkSession) -> None:
    got = replayed(spark, doc(("chunk", "a", "1"), ("chunk", "b", "2"), ("text", "c", "3")), [("update", "b", None, None, "title", None), ("delete", "a")])
    assert [(r[0], r[3]) for r in got] == [("text", "12"), ("text", "3")]


def test_snapshots_and_whole_documents(spark: SparkSession) -> None:
    """A log in parts gives what it gives at once; documents come from set alone, and end without items."""
    random.seed(1)
    items = spark.createDataFrame([(d, n, random.choice(["chunk", "text"]), f"{d}/{n}", None, random.choice(["a b c", " ", "éé"])) for d in range(30) for n in range(6)], "doc long, ord int, kind string, id string, title string, content string").withColumn("seq", F.lit(0))
    rows = []
    for d in range(31):
        for s in range(40):
            made = [f"{d}/{random.randint(0, 5)}", replay.new_id(d, random.randint(0, s), random.randint(0, 2))]
            rows.append((d, s, random.choice(["create", "create", "delete", "update"]), random.choice(made), random.randint(-2, 2), random.randint(0, 4), random.choice(["title", "content", "keywords"]), random.choice([None, "new t"]), ["k"]))
    log = spark.createDataFrame(rows, LOG).repartition(5)
    items_type = replay.ACTION["items"]
    log = log.withColumn("items", F.lit(None).cast(items_type)).unionByName(spark.range(1).select(F.lit(99).cast("long").alias("doc"), F.lit(0).cast("long").alias("seq"), F.lit("set").alias("action"), F.from_json(F.lit('[{"id": "s", "content": "set"}]'), items_type).alias("items")), allowMissingColumns=True)
    own = replay.complete(items)
    whole = sorted(map(str, replay.replay(own, log).collect()))
    halves = replay.replay(replay.replay(own, log.where("seq < 20")), log.where("seq >= 20"))
    assert whole == sorted(map(str, halves.collect()))
    assert any("content='set'" in r for r in whole)
    assert replay.replay(own, log.limit(0)).count() == 180
    assert replay.replay(own.limit(0), log.where("doc < 99")).count() == 0
    selected = spark.createDataFrame([(1, 1, "select", "a", 0, 2, None, None, None), (1, 2, "select", "b", 1, 3, None, None, None)], LOG)
    assert [tuple(r) for r in replay.selections(selected).collect()] == [(1, "b", 1, 3)]


def test_anchored_windows(spark: SparkSession) -> None:
    random.seed(2)
    rows = [(random.choice([None, "a", "b", "c"]), T0 + timedelta(milliseconds=random.choice([5, 40, 99, 100, 101]) * random.randint(0, 40)), i, f"{i};") for i in range(500)]
    rows += [("late", T0 + timedelta(milliseconds=t), t, f"{t};") for t in (95, 105, 190, 195, 295)] + [("none", None, 0, "x")]
    expected = {}
    for key in {r[0] for r in rows}:
        start = None
        for _, ts, seq, content in sorted((r for r in rows if r[0] == key and r[1]), key=lambda r: (r[1], r[2])):
            if start is None or ts >= start + timedelta(milliseconds=100):
                start = ts
            expected[(key, start)] = expected.get((key, start), "") + content
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = response.coalesced(spark.createDataFrame(rows, "request_id string, ts timestamp, seq long, content string")).withColumn("at", F.timestamp_micros("anchor")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert {(r["request_id"], r["at"]): r["content"] for r in got} == expected
    assert expected["late", T0 + timedelta(milliseconds=95)] == "95;105;190;"


EVENT = "request_id string, ts timestamp, seq long, type string, tokens long, cpu_kWh double, gpu_kWh double, ram_kWh double, total_kWh double, duration double"


def event(request: str, second: float, seq: int, kind: str, tokens: int | None = None, kwh: float | None = None) -> tuple:
    return (request, T0 + timedelta(seconds=second), seq, kind, tokens, kwh, kwh, kwh, kwh and 3 * kwh, kwh and 1.0)


EVENTS = [
    event("r", 0, 0, "open"), event("r", 1, 1, "power_index", kwh=1.0), event("r", 2, 2, "sources", tokens=7), event("r", 3, 3, "power_prompt", kwh=2.0),
    event("r", 4, 4, "user"), event("r", 5, 5, "assistant"), event("r", 6, 6, "power_response", kwh=4.0), event("r", 7, 7, "close"), event("r", 8, 8, "power_response", kwh=9.0),
    event("f", 0, 0, "open"), event("f", 1, 1, "failure"), event("f", 6, 2, "failure"), event("f", 12, 3, "heartbeat"), event("f", 13, 4, "heartbeat"), event("f", 20, 5, "sources", tokens=3),
    event("e", 3, 0, "close"),
]


def test_steps(spark: SparkSession) -> None:
    got = response.steps(spark.createDataFrame(EVENTS, EVENT)).orderBy("request_id", "seq").collect()
    of = lambda r, c: [x[c] for x in got if x["request_id"] == r]
    assert of("r", "step") == ["research", "research", "prompt", "prompt", "output", "output", "output", "done", "done"]
    assert of("f", "step") == ["research", "initial", "initial", "initial", "initial", "prompt"]
    # The first failure's timer brings the service back, though it failed again meanwhile.
    assert of("f", "available") == [True, False, False, False, True, True]
    assert of("r", "kWh_so_far") == [0, 0, 0, 6, 6, 6, 18, 18, 45]
    assert of("r", "tokens_so_far") == [0, 0, *[7] * 7]


TOTALS = [("e", 0, 0, 0, *[0.0] * 6), ("r", 7, 7, 3, 18.0, 7.0, 7.0, 7.0, 21.0, 3.0)]


def test_totals(spark: SparkSession) -> None:
    assert sorted(tuple(r) for r in response.totals(spark.createDataFrame(EVENTS, EVENT)).collect()) == TOTALS
    assert response.totals(spark.createDataFrame([], EVENT)).collect() == []


def streamed(spark: SparkSession, folder: Path, batches: list[list[tuple]], schema: str, operator: Callable[[DataFrame], DataFrame], name: str) -> list[tuple]:
    """What a stream makes of the batches, one file and micro-batch each."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(folder / "in")
    query = None
    try:
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            if n == 0:
                query = operator(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "checkpoint")).start()
            query.processAllAvailable()
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        if query:
            query.stop()
        spark.conf.set(provider, held)


def test_anchored_stream(spark: SparkSession, tmp_path: Path) -> None:
    """A window opens with its first part, though parts come in another order, in several batches."""
    part = lambda r, ms: (r, T0 + timedelta(milliseconds=ms), ms, f"{ms};")
    batches = [[part("a", 190), part("a", 105), part("b", 0)], [part("a", 95), part("a", 195), part("b", 99), part("b", 100)], [part("z", 5000)], [part("z", 5001)]]
    got = streamed(spark, tmp_path, batches, "request_id string, ts timestamp, seq long, content string", streaming.anchored, "anchored")
    at = lambda ms: T0 + timedelta(milliseconds=ms)
    assert sorted(got) == [("a", at(95), "95;105;190;", 3), ("a", at(195), "195;", 1), ("b", at(0), "0;99;", 2), ("b", at(100), "100;", 1)]


def test_totals_stream(spark: SparkSession, tmp_path: Path) -> None:
    """Told once, at the close, with what came late; what is sent after it doesn't count."""
    rows = {(r[0], r[2]): r for r in EVENTS}
    late = [rows["r", 6]]
    batches = [[r for r in EVENTS if r not in late], late, [event("z", 100, 0, "open")], [event("z", 200, 1, "open")]]
    got = streamed(spark, tmp_path, batches, EVENT, lambda e: streaming.totals_at_close(e, "30 seconds"), "totals")
    assert sorted(got) == TOTALS


CHANGE = "key string, request_id string, ts timestamp, seq long, change int"
CHANGES = [(k, r, T0 + timedelta(seconds=t), s, c) for k, r, t, s, c in [("k", "a", 0, 0, 1), ("k", "b", 1, 1, 1), ("k", "a", 3, 2, -1), ("k", "a", 4, 3, -1), ("k", "c", 11, 4, 1), ("k", "b", 12, 5, -1), ("k", "c", 13, 6, -1), ("j", "x", 2, 7, -1), ("j", "y", 5, 8, 1), ("j", "y", 6, 9, 1)]]
OPEN = [("j", "y", 5, 8, 1, False, 1), ("j", "y", 15, None, -1, True, 0), ("k", "a", 0, 0, 1, False, 1), ("k", "a", 3, 2, -1, False, 1), ("k", "b", 1, 1, 1, False, 2), ("k", "b", 11, None, -1, True, 0), ("k", "c", 11, 4, 1, False, 1), ("k", "c", 13, 6, -1, False, 0)]


def plain(rows: list[tuple]) -> list[str]:
    return sorted(map(str, ((k, r, (ts - T0).total_seconds(), None if s is None or s != s else int(s), c, a, n) for k, r, ts, s, c, a, n in rows)))  # noqa: PLR0124


def test_open_requests(spark: SparkSession) -> None:
    """A request that nobody ends is given up; what comes for it later counts for nothing."""
    from lodestone.operators import events

    assert plain([tuple(r) for r in events.open_requests(spark.createDataFrame(CHANGES, CHANGE), 10).collect()]) == plain([(k, r, T0 + timedelta(seconds=t), *x) for k, r, t, *x in OPEN])
    assert events.open_requests(spark.createDataFrame([], CHANGE), 10).collect() == []


def test_open_requests_stream(spark: SparkSession, tmp_path: Path) -> None:
    later = [("z", "z", T0 + timedelta(seconds=t), 99, -1) for t in (500, 600)]
    batches = [CHANGES[4:7] + CHANGES[:1], CHANGES[1:4] + CHANGES[7:], later[:1], later[1:]]
    got = streamed(spark, tmp_path, batches, CHANGE, lambda c: streaming.open_requests(c, 10_000, "60 seconds"), "opened")
    assert plain(got) == plain([(k, r, T0 + timedelta(seconds=t), *x) for k, r, t, *x in OPEN])


def test_a_batch_that_runs_again_adds_nothing(spark: SparkSession, tmp_path: Path) -> None:
    schema = "request_id string, type string, seq long, ts timestamp, value string"
    row = lambda n, s: (f"r{n}", "user", 0, T0 + timedelta(seconds=s), f"v{n}")
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run() -> list[str]:
        events = streaming.tracked_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        query = events.writeStream.foreachBatch(streaming.into(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(r["value"] for r in spark.read.parquet(out).collect())

    spark.createDataFrame([row(1, 0), row(2, 1), row(1, 2)], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == ["v1", "v2"]
    spark.createDataFrame([row(3, 3), row(2, 4)], schema).coalesce(1).write.mode("append").parquet(source)
    once = run()
    assert once == ["v1", "v2", "v3"]
    # As if it had failed after its output and before it was told done: the last batch runs again.
    commits = sorted((p for p in (tmp_path / "checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run() == once


def test_chunk_files(spark: SparkSession, tmp_path: Path) -> None:
    import json

    from lodestone.sources import chunk_files, writers

    rows = [("d", n, kind, i, t, c, ["k"]) for n, (kind, i, t, c) in enumerate([("chunk", "a", "old", "1"), ("chunk", "b", "ü", "2\n"), ("text", "c", None, "3"), ("raw", None, None, "4"), ("chunk", "", "x", "5"), ("chunk", "a", "new", "6"), ("chunk", None, "x", "7")])]
    chunks = spark.createDataFrame(rows, "dataset_id string, ord int, kind string, id string, title string, content string, keywords array<string>").repartition(3)
    (tmp_path / "out").mkdir()
    (tmp_path / "out/other.json").write_text("{}")
    assert writers.split_chunks(chunks, str(tmp_path / "out")) == 3
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["_SUCCESS", "a.json", "b.json", "other.json"]
    assert json.loads((tmp_path / "out/a.json").read_text()) == {"id": "a", "title": "new", "content": "6", "keywords": ["k"]}
    assert (tmp_path / "out/b.json").read_text() == '{\n  "id": "b",\n  "title": "ü",\n  "content": "2\\n",\n  "keywords": [\n    "k"\n  ]\n}'

    # Of a write that fails, nothing is published; a task that is being killed may still leave an unused folder.
    bad = spark.range(20).select(F.when(F.col("id") == 13, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    chunk_files.register(spark)
    with pytest.raises(Exception, match="broken"):
        bad.write.format("chunk_files").mode("append").save(str(tmp_path / "bad"))
    assert all(p.name.startswith("_staging-") for p in (tmp_path / "bad").glob("*"))
