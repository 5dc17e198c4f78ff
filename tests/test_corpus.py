"""Golden cases of text preparation, alignment, annotation, graph, energy, events and streams."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from lodestone.functions import numbers, text
from lodestone.operators import align, annotate, events, graph, power, validate
from lodestone.sources import readers, writers
from lodestone.streaming import operators as streaming


def of(spark, value, f):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize("value", ["  a b ", " x ", "\x1cx\x1f", "﻿x", "", " \n", "a\n", "\x85y"])
def test_strip(spark, value):  # noqa: ANN001
    assert of(spark, value, text.py_strip) == value.strip()


@pytest.mark.parametrize("value", ["a\nb", "a\r\nb\rc", "a\n\n", "", "a\x0bb\x0cc\x1cd\x85e f", "\n"])
def test_splitlines(spark, value):  # noqa: ANN001
    assert of(spark, value, text.splitlines) == value.splitlines()


def test_normalize(spark):  # noqa: ANN001
    assert of(spark, " a \n b\tc ", text.normalize_spaces) == "a b c"


def test_preprocess(spark):  # noqa: ANN001
    assert of(spark, "KAPITEL I\n\nFoo\nArtikel 1\nBar\n(1)\nx\na)\ny", text.preprocess) == "# KAPITEL I: Foo\n### Artikel 1: Bar\n(1) x\na) y"


def test_preview_and_rule(spark):  # noqa: ANN001
    assert of(spark, "x" * 151, text.preview) == "x" * 150 + "..."
    assert of(spark, "x" * 150, text.preview) == "x" * 150
    assert of(spark, "a\n  Titel: b", text.rule_before_titles) == "a\n<hr>  Titel: b"


def lines(spark, chunks, de, en, compat=True):  # noqa: ANN001, ANN201
    c = spark.createDataFrame(chunks, "chunk_idx int, content string").select("chunk_idx", align.normalised_lines().alias("lines"))
    r = spark.createDataFrame([(i, d, en[i] if i < len(en) else None) for i, d in enumerate(de)], "line_no int, de string, en string")
    return align.align(c, r, compat)


def test_alignment(spark):  # noqa: ANN001
    got = lines(spark, [(0, "A\nB C\nQ")], ["A B C", "D"], ["E1", "E2"])
    assert [(r["original_content"], r["content"]) for r in got.orderBy("seq").collect()] == [("A B C", "E1"), ("Q", "")]
    assert align.consolidate(got).first()["content"] == "E1\n"
    assert [r["original_line"] for r in align.unmatched(got).collect()] == ["Q"]
    blank = [(0, "A\n\nB C\nQ")]
    assert [r["original_content"] for r in lines(spark, blank, ["A B C"], ["E1"]).orderBy("seq").collect()] == ["A B C", "B C", "Q"]
    cut = lines(spark, [(0, "A")], ["A B C"], ["E1"])
    assert cut.first()["original_content"] == "A B C"  # the whole reference line
    own = spark.createDataFrame([(0, "i", None, ["r"])], "chunk_idx int, id string, title string, relevantChunksIds array<string>")
    assert align.consolidate(cut, own).first().asDict() == {"chunk_idx": 0, "id": "i", "title": "N/A", "relevantChunksIds": ["r"], "keywords": [], "availableKeywords": [], "negativeKeywords": [], "parameters": [], "content": "E1", "original_content": "A B C"}
    assert align.counts(own, cut).first().asDict() == {"n_chunks": 1, "n_consolidated": 1, "n_entries": 1, "n_unmatched": 0}
    assert [r["original_content"] for r in lines(spark, blank, ["A B C"], ["E1"], False).orderBy("seq").collect()] == ["A B C", "Q"]


def restated(content, de, en):  # noqa: ANN001, ANN201
    items, out, at = [" ".join(x.split()) for x in content.split("\n")], [], 0
    while at < len(items):
        if not items[at]:
            at += 1
            continue
        hit = next((i for i, d in enumerate(de) if d.startswith(items[at]) and i < len(en)), None)
        if hit is None:
            out.append((items[at], ""))
            at += 1
            continue
        whole, taken, k = items[at], 1, at + 1
        while k < len(items):
            if items[k]:
                if not de[hit].startswith(whole + " " + items[k]):
                    break
                whole, taken = whole + " " + items[k], taken + 1
            k += 1
        out.append((de[hit], en[hit]))
        at += taken
    return out


def test_alignment_against_restatement(spark):  # noqa: ANN001
    random.seed(5)
    de = [" ".join(random.choices("abc", k=random.randint(1, 20))) for _ in range(12)]
    en = [f"E{i}" for i in range(10)]
    chunks = [(i, "\n".join(random.choice(["", "a", "b c", "a b", *random.choices(de, k=2), "zz"]) for _ in range(8))) for i in range(30)]
    got = {}
    for r in lines(spark, chunks, de, en).orderBy("chunk_idx", "seq").collect():
        got.setdefault(r["chunk_idx"], []).append((r["original_content"], r["content"]))
    assert got == {i: x for i, c in chunks if (x := restated(c, de, en))}


ITEMS = "doc long, ord int, kind string, id string, title string, content string, relevantChunksIds array<string>"


def test_delete_merges_direct_neighbours(spark):  # noqa: ANN001
    rows = [(1, i, k, f"i{i}", None, c, []) for i, (k, c) in enumerate([("text", "a"), ("text", "b"), ("chunk", "c"), ("text", "d"), ("text", "e")])]
    items = spark.createDataFrame(rows, ITEMS)
    gone = spark.createDataFrame([(1, "i2")], "doc long, id string")
    assert [(r["ord"], r["kind"], r["content"]) for r in annotate.delete_chunk(items, gone).orderBy("ord").collect()] == [(0, "text", "a"), (1, "text", "bcd"), (2, "text", "e")]


def test_delete_purges_blanks(spark):  # noqa: ANN001
    rows = [(d, i, k, f"i{i}", None, c, []) for d in (1, 2) for i, (k, c) in enumerate([("text", " "), ("chunk", "x"), ("chunk", "c"), ("chunk", "\n")])]
    got = annotate.delete_chunk(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([(1, "i2")], "doc long, id string"))
    assert [(r["doc"], r["ord"], r["kind"], r["content"]) for r in got.orderBy("doc", "ord").collect()] == [(1, 0, "chunk", "x"), (1, 1, "text", "c"), (2, 0, "text", " "), (2, 1, "chunk", "x"), (2, 2, "chunk", "c"), (2, 3, "chunk", "\n")]


def test_fixed(spark):  # noqa: ANN001
    random.seed(6)
    values = [0.1235, 1.005, 0.5, 2.5, 1.25, -0.04, 0.0, 1e-9, 123456.7890625, 4_000_000.125, *[random.uniform(-1, 1) * 10 ** random.randint(-6, 6) for _ in range(400)], *[random.randint(0, 2000) / 8 for _ in range(100)]]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 1, 2, 6):
        for v, (got,) in zip(values, table.select(numbers.fixed(F.col("x"), places)).collect(), strict=True):
            own = str(Decimal(abs(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
            assert got == ("-" if v < 0 else "") + own.replace("0E-6", "0.000000"), (v, places)
    row = table.limit(1).select(numbers.percent(F.lit(0.1235)), numbers.german_decimal(F.lit(1.005), 2), numbers.json_number(F.lit(float("nan"))), numbers.power_label(F.lit("power_prompt")), numbers.power_label(F.lit("user")), numbers.next_step(F.lit("sources"), F.lit("research")), numbers.next_step(F.lit("assistant"), F.lit("output")), numbers.dataset_of(F.lit("fr"), {"en": "e", "de": "d"}), numbers.dataset_of(F.lit("en"), {"en": "e", "de": "d"})).first()
    assert list(row) == ["12.3%", "1,00", None, numbers.POWER_LABELS["power_prompt"], "", "prompt", "output", "d", "e"]


def test_small_texts(spark):  # noqa: ANN001
    one = spark.range(1)
    assert one.select(text.mail_link("a@b", F.lit("S t"), F.lit("x+y\n(é)!"))).first()[0] == "mailto:a@b?subject=S%20t&body=x%2By%0A(%C3%A9)!"
    assert one.select(text.root_of(F.lit("/a/b/src/c"))).first()[0] == "/a/b/"
    assert one.select(text.hover(F.lit("T"), F.lit(3), F.lit("xyz"))).first()[0] == "Title: T | Content Length: 3 | xyz..."
    options = spark.createDataFrame([("a", "A"), ("b", "B")], "value string, label string")
    assert {tuple(r) for r in annotate.option_labels(spark.createDataFrame([("a",), ("z",)], "value string"), options).collect()} == {("a", "A"), ("z", "z")}
    listed = options.agg(F.collect_list(F.struct("value", "label")).alias("o"))
    assert [o["value"] for o in listed.select(annotate.other_options(F.col("o"), F.lit("a"))).first()[0]] == ["b"]
    with pytest.raises(ValueError, match="HOST"):
        validate.require_services({"HOST": None}, {})
    with pytest.raises(ValueError, match="embedding"):
        validate.require_services({"HOST": "h"}, {"embedding": [""]})


STREAMED = "request_id string, ts timestamp, seq long, type string, content string, total_kWh double, user_id long"


def streamed(spark, tmp_path, rows, make, mode):  # noqa: ANN001, ANN201
    """What a stream of the rows, each a file of its own in order, leaves in memory."""
    for i, r in enumerate(rows):
        spark.createDataFrame([r], STREAMED).coalesce(1).write.parquet(str(tmp_path / f"in/{i:02d}"))
    source = spark.readStream.schema(STREAMED).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    name = f"out_{mode}_{random.randrange(10**9)}"
    make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name).collect()


def test_stream_of_parts_and_sessions(spark, tmp_path):  # noqa: ANN001
    at = lambda ms: datetime(2026, 1, 1) + timedelta(milliseconds=ms)
    rows = [("a", at(10), 1, "assistant", "y", 1.0, 1), ("a", at(5), 0, "assistant", "x", 1.0, 1), ("a", at(150), 2, "assistant", "z", 1.0, 1), ("b", at(20), 0, "user", "q", 2.0, 2), ("b", at(10_000_000), 1, "user", "r", 2.0, 2)]
    got = streamed(spark, tmp_path / "w", rows, streaming.coalesced, "append")
    assert {(r["request_id"], r["content"]) for r in got} >= {("a", "xy"), ("a", "z"), ("b", "q")}
    got = streamed(spark, tmp_path / "s", rows, lambda s: streaming.sessions(s).select("user_id", "n"), "append")
    assert {tuple(r) for r in got} >= {(1, 3)}
    got = streamed(spark, tmp_path / "t", rows, streaming.totals, "complete")
    assert {tuple(r) for r in got} == {("a", 3.0, 3), ("b", 4.0, 2)}


def test_dispatch(spark):  # noqa: ANN001
    batch = spark.createDataFrame([("user", "q"), ("assistant", "a"), ("error", "e")], "type string, content string")
    seen = {}
    streaming.dispatch(batch, {k: lambda rows, k=k: seen.setdefault(k, [r["content"] for r in rows.collect()]) for k in ("user", "assistant", "sources")})
    assert seen == {"user": ["q"], "assistant": ["a"], "sources": []}


def test_create_chunk(spark):  # noqa: ANN001
    items = spark.createDataFrame([(1, 0, "text", "t", None, "ab  cd", []), (1, 1, "chunk", "c", "", "xyz", [])], ITEMS)
    cut = lambda *s: [(r["kind"], r["content"]) for r in annotate.create_chunk(items, spark.createDataFrame([(1, *s)], "doc long, id string, start long, end long")).orderBy("ord").collect()]
    assert cut("t", 0, 2) == [("chunk", "ab"), ("text", "cd"), ("chunk", "xyz")]
    assert cut("t", 2, 4) == [("text", "ab"), ("chunk", ""), ("text", "cd"), ("chunk", "xyz")]
    assert cut("t", 3, 3) == cut("c", 0, 1) == [("text", "ab  cd"), ("chunk", "xyz")]


def test_enrichment(spark):  # noqa: ANN001
    chunks = spark.createDataFrame([(0, "a", "Art 1", "xxx", ["b", "b", "zz"]), (1, "b", "", "yyyyy", [])], "ord int, id string, title string, content string, relevantChunksIds array<string>")
    got = graph.enrich(chunks).orderBy("ord").collect()
    assert [(r["content_length"], r["content_plus_length"], r["relevantChunksIdsNum"]) for r in got] == [(3, 13, 3), (5, 5, 0)]
    assert [(r["src"], r["dst"]) for r in graph.edges_by_id(chunks).collect()] == [("a", "b")]
    assert graph.edges_by_title(chunks).collect() == []
    assert {r["title"]: r["color"] for r in graph.nodes_by_title(chunks).collect()} == {"Art 1": "SpringGreen", "": "gray"}


def test_queue_and_totals(spark):  # noqa: ANN001
    got = spark.createDataFrame([(1,), (2,), (3,)], "p int").select(numbers.queue_seconds(F.col("p"))).collect()
    assert [r[0] for r in got] == [40, 40, 80]
    rows = spark.createDataFrame([(1, n, k, 0.0, 0.0, k, 1.0) for n, k in (("power_index", 5.0), ("power_prompt", 1.0), ("power_response", 2.0))], "q int, name string, cpu_kWh double, gpu_kWh double, ram_kWh double, total_kWh double, duration double")
    r = power.totals(rows, "q").first()
    assert (r["per_query_kWh"], r["total_kWh"]) == (3.0, 8.0)


def test_counter(spark):  # noqa: ANN001
    random.seed(1)
    rows = [(k, i, random.choice([1, -1, -1])) for k in range(3) for i in range(30)]
    changes = spark.createDataFrame(rows, "key int, seq long, change int")
    expected = {}
    now = {}
    for k, i, c in rows:
        now[k] = max(0, now.get(k, 0) + c)
        expected[k, i] = now[k]
    assert {(r["key"], r["seq"]): r["active"] for r in events.active_requests(changes, "key", ["seq"]).collect()} == expected


def test_counter_stream(spark, tmp_path):  # noqa: ANN001
    rows = [("a", 0, 1), ("a", 1, -1), ("a", 2, -1), ("a", 3, 1), ("b", 0, 1)]
    spark.createDataFrame(rows, "key string, seq long, change int").write.parquet(str(tmp_path / "in"))
    stream = streaming.active_requests(spark.readStream.schema("key string, seq long, change int").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r["key"], r["seq"]): r["active"] for r in spark.table("counted").collect()} == {("a", 0): 1, ("a", 1): 0, ("a", 2): 0, ("a", 3): 1, ("b", 0): 1}


def test_frames(spark):  # noqa: ANN001
    row = spark.createDataFrame([("user", 'x"\n\n'), ], "t string, c string").withColumn("f", events.frame(F.col("t"), F.col("c")))
    assert row.first()["f"] == 'data: {"type":"user","content":"x\\"\\n\\n"}\n\n'
    assert row.select(events.parse(F.col("f"), "string").alias("e")).first()["e"]["content"] == 'x"\n\n'


def test_manual_index(spark, tmp_path):  # noqa: ANN001
    path = tmp_path / "index.json"
    path.write_text('{"id": "x", "date_created": 7, "chunks": ["raw", {"id": "t", "content": "plain"}, {"id": "c", "title": "T", "content": "body", "keywords": [], "negativeKeywords": [], "relevantChunksIds": ["t"], "parameters": [], "position": 9}]}')
    got = readers.manual_index(spark, str(path), "ds").orderBy("ord").collect()
    assert [(r["kind"], r["id"], r["content"]) for r in got] == [("raw", None, "raw"), ("text", "t", "plain"), ("chunk", "c", "body")]
    assert {r["creation_date"] for r in got} == {7}
    assert readers.manual_index(spark, str(path), strict=True).first()["creation_date"] == 0
    assert readers.raw_as_text(readers.manual_index(spark, str(path))).where("kind = 'text' AND id IS NOT NULL").count() == 2
    chunks = readers.manual_index(spark, str(path), "ds")
    assert writers.split_chunks(chunks, str(tmp_path / "out")) == 1
    assert (tmp_path / "out" / "c.json").exists()
    assert '"title" : "T"' in writers.document(chunks).first()["value"]


def test_text_sources(spark, tmp_path):  # noqa: ANN001
    (tmp_path / "lines.txt").write_text("a\n\nb\n")
    assert [(r["line_no"], r["text"]) for r in readers.lines(spark, str(tmp_path / "lines.txt")).orderBy("line_no").collect()] == [(0, "a"), (1, ""), (2, "b")]
    (tmp_path / "qa.md").write_text("﻿\n# 1. What?\n\nAntwort:\nThis [1].\n\nQuellen:\n[1] Art 3: Z1\n[2] Art 4\n\n\n# 2. Why?\n\nAntwort:\nSo.\n\nQuellen:\n[1] X\n")
    got = readers.questions(spark, str(tmp_path / "qa.md")).orderBy("q_no").collect()
    assert [(r["q_no"], r["question"], r["answer"], r["sources"]) for r in got] == [(1, "What?", "This [1].", ["Art 3: Z1", "Art 4"]), (2, "Why?", "So.", ["X"])]
    (tmp_path / "m.xlf").write_text('<xliff><file><body><trans-unit id="u"><source>S</source><target state="translated">T</target><context-group purpose="location"><context context-type="sourcefile">f.html</context><context context-type="linenumber">3</context></context-group></trans-unit><trans-unit id="v"><source>S2</source><target>T2</target></trans-unit></body></file></xliff>')
    got = readers.catalogue(spark, str(tmp_path / "m.xlf")).orderBy("id").collect()
    assert [(r["id"], r["source"], r["target"], r["target_state"], r["file"], r["line"]) for r in got] == [("u", "S", "T", "translated", "f.html", 3), ("v", "S2", "T2", None, None, None)]
    (tmp_path / "inj.md").write_text('# [X](#x)\n\n## [First one]\nFrage:  \n"Say "no" now"  \n![i](u)\n\n## [Second] \nFrage:  \n"a"  \n\nFrage:  \n"b"\n')
    assert [tuple(r) for r in readers.scenarios(spark, str(tmp_path / "inj.md")).orderBy("scenario", "prompt_no").collect()] == [("First one", 0, 'Say "no" now'), ("Second", 0, "a"), ("Second", 1, "b")]
    assert {r["key"]: r["value"] for r in readers.json_map('{"a": "b"}', spark).collect()} == {"a": "b"}


def test_store_keeps_other_datasets(spark, tmp_path):  # noqa: ANN001
    path = str(tmp_path / "store")
    writers.vector_store(spark.createDataFrame([("a", 1), ("b", 2)], "dataset_id string, x int"), path)
    writers.vector_store(spark.createDataFrame([("a", 3)], "dataset_id string, x int"), path)
    assert {(r["dataset_id"], r["x"]) for r in readers.vector_store(spark, path).collect()} == {("a", 3), ("b", 2)}
    plan = readers.vector_store(spark, path, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan


def test_validation(spark):  # noqa: ANN001
    a = spark.createDataFrame([("x",), ("y",)], "dataset_id string")
    b = spark.createDataFrame([("y",), ("z",)], "dataset_id string")
    assert {(r[0], r[1]) for r in validate.inconsistent(a, b).collect()} == {("x", "prompt"), ("z", "dataset")}
    c = spark.createDataFrame([('{"id":"a","title":"","content":"c","keywords":[],"negativeKeywords":[],"relevantChunksIds":[],"parameters":[]}',), ('{"id":"a","content":"c"}',), ('"s"',)], "j string").select(F.parse_json("j").alias("v"))
    assert [tuple(r) for r in c.select(validate.is_manual_chunk(F.col("v")), F.coalesce(validate.is_text_item(F.col("v")), F.lit(False))).collect()] == [(True, True), (False, True), (False, False)]
