"""Readers and writers of stores and records, and checks that no query calls."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import annotate, index, power, validate
from lodestone.sources import readers, writers


def test_power_record(spark, tmp_path):  # noqa: ANN001
    record = spark.createDataFrame([(1.5, 2.0, 0.5, 4.0, 12.0)], "cpu_kWh double, gpu_kWh double, ram_kWh double, total_kWh double, duration double")
    writers.power_record(record, str(tmp_path / "power"))
    back = readers.power_record(spark, str(tmp_path / "power")).collect()
    assert [(r["total_kWh"], r["duration"], r["error"]) for r in back] == [(4.0, 12.0, None)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "power.json").write_text("")
    assert [r["error"] for r in readers.power_record(spark, str(tmp_path / "none")).collect()] == ["no power data"]
    written = spark.createDataFrame([(1, 1.0), (3, 3.0), (2, 2.0)], "written int, total_kWh double")
    assert power.last_of_index(written).first()["total_kWh"] == 3.0


def test_documents_and_lines(spark, tmp_path):  # noqa: ANN001
    chunks = spark.createDataFrame([("a", 2, "y", "zwei ä"), ("a", 1, "x", "eins"), ("b", 1, "z", None)], "dataset_id string, ord int, id string, content string")
    held = {r["dataset_id"]: json.loads(r["value"])["chunks"] for r in writers.document(chunks).collect()}
    assert held == {"a": [{"id": "x", "content": "eins"}, {"id": "y", "content": "zwei ä"}], "b": [{"id": "z"}]}
    writers.json_lines(chunks.select("id", "content"), str(tmp_path / "lines"))
    lines = [json.loads(line) for f in (tmp_path / "lines").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == ["x", "y", "z"]
    assert writers.document(chunks.limit(0)).collect() == []


def test_base64_of_any_text(spark):  # noqa: ANN001
    texts = ["", "ä€😀", "a" * 200_000, "line\r\nline"]
    back = readers.decoded(writers.encoded(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), "text"), "text")
    assert [r["text"] for r in back.orderBy("n").collect()] == texts


def test_store_keeps_other_data_sets(spark, tmp_path):  # noqa: ANN001
    path = str(tmp_path / "store")
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "dataset_id string, id string")
    writers.vector_store(store, path)
    writers.vector_store(spark.createDataFrame([("a", "3")], "dataset_id string, id string"), path)
    assert sorted((r["dataset_id"], r["id"]) for r in readers.vector_store(spark, path).collect()) == [("a", "3"), ("b", "2")]
    assert [r["id"] for r in readers.vector_store(spark, path, "b").collect()] == ["2"]


def test_checks_of_documents_and_selections(spark):  # noqa: ANN001
    chunk = '{"id": "c", "title": "", "content": "x", "keywords": [], "negativeKeywords": [], "relevantChunksIds": [], "parameters": []}'
    docs = {
        '{"id": "d", "chunks": ["plain", {"id": "t", "content": "x"}, %s]}' % chunk: True,
        '{"id": "d", "chunks": [], "date_created": 5}': True,
        '{"id": "d", "chunks": [], "date_created": "today"}': False,
        '{"chunks": []}': False,
        '{"id": "d"}': False,
        '{"id": "d", "chunks": [7]}': False,
        '{"id": "d", "chunks": [{"id": "t"}]}': False,
    }
    rows = spark.createDataFrame([(k,) for k in docs], "raw string").select("raw", validate.is_manual_index(F.parse_json("raw")).alias("ok"))
    assert {r["raw"]: r["ok"] for r in rows.collect()} == docs
    marks = [(0, 3, "a", True), (3, 3, "a", False), (0, 0, "a", False), (-1, 3, "a", False), (5, 3, "a", True), (0, 3, "", False)]
    got = spark.createDataFrame(marks, "s int, e int, id string, want boolean").select("want", annotate.selection_valid(F.col("s"), F.col("e"), F.col("id")).alias("ok"))
    assert all(r["ok"] == r["want"] for r in got.collect())


def test_only_indexed_chunks_reach_the_model(spark):  # noqa: ANN001
    def load():  # noqa: ANN202
        def model(texts):  # noqa: ANN001, ANN202
            assert len(texts) <= 3 and all(t.startswith("passage: ") and t.strip() != "passage:" for t in texts)
            return [[float(len(t))] for t in texts], 0.5

        return model

    rows = [("a", i, "raw" if i == 4 else "chunk", str(i), None, " " if i == 2 else "x" * i, []) for i in range(1, 9)]
    chunks = spark.createDataFrame(rows, "dataset_id string, ord long, kind string, id string, title string, content string, relevantChunksIds array<string>")
    built = index.build_with(chunks, load, "multilingual-e5-large", 3).orderBy("position").collect()
    assert [(r["id"], r["vector"]) for r in built] == [(str(i), [9.0 + i]) for i in (1, 3, 5, 6, 7, 8)]
    calls = sum(r["seconds"] for r in built) / 0.5
    assert calls == int(calls) >= 2
