"""Golden cases of retrieval, index building and prompts, and the packing fold against a plain restatement."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.conf import EngineConf
from lodestone.functions import text, vector
from lodestone.operators import embed, index, prompt, retrieve

EXPANDED = "query_id long, rank int, id string, num_tokens int, related array<struct<at:int,id:string,title:string,content:string,num_tokens:int,position:int>>"


def expanded(spark, tops, query=1):  # noqa: ANN001, ANN201
    rows = [(query, r, i, n, [(k, j, "", "", m, 0) for k, (j, m) in enumerate(rel)]) for r, (i, n, rel) in enumerate(tops, 1)]
    return spark.createDataFrame(rows, EXPANDED)


def verdicts(spark, tops, limit):  # noqa: ANN001, ANN201
    return [(r["id"], r["skip_reason"]) for r in retrieve.pack(expanded(spark, tops), limit).orderBy("rank", "at").collect()]


@pytest.mark.parametrize(
    ("tops", "limit", "expected"),
    [
        ([("A", 4, []), ("B", 7, []), ("C", 1, [])], 10, [("A", ""), ("B", "context_window"), ("C", "context_window")]),
        ([("A", 1, [("B", 1), ("B", 1), ("A", 1)]), ("B", 1, [("C", 1)])], 100, [("A", ""), ("B", ""), ("B", "duplicate"), ("A", "duplicate"), ("B", "duplicate")]),
        ([("A", 3, [("X", 9), ("Y", 1)]), ("B", 1, [])], 5, [("A", ""), ("X", "context_window"), ("Y", "context_window"), ("B", "context_window")]),
        ([("A", 3, [("B", 2)]), ("C", 9, []), ("B", 2, [])], 5, [("A", ""), ("B", ""), ("C", "context_window"), ("B", "context_window")]),
        ([("A", 0, []), ("B", 1, [])], 0, [("A", ""), ("B", "context_window")]),
        ([("A", 0, [])], -1, [("A", "context_window")]),
    ],
)
def test_packing(spark, tops, limit, expected):  # noqa: ANN001
    assert verdicts(spark, tops, limit) == expected


def restated(tops, limit):  # noqa: ANN001, ANN201
    total, full, added, out = 0, False, set(), []

    def one(i, n):  # noqa: ANN001, ANN202
        nonlocal total, full
        if full:
            return "context_window"
        if i in added:
            return "duplicate"
        if total + n > limit:
            full = True
            return "context_window"
        total += n
        added.add(i)
        return ""

    for i, n, rel in tops:
        out.append((i, one(i, n)))
        if out[-1][1] == "":
            out += [(j, one(j, m)) for j, m in rel]
    return out


def test_packing_against_restatement(spark):  # noqa: ANN001
    random.seed(3)
    tokens = {c: random.randint(0, 6) for c in "abcdefgh"}
    cases = [[(c, tokens[c], [(d, tokens[d]) for d in random.choices("abcdefgh", k=random.randint(0, 4))]) for c in random.choices("abcdefgh", k=5)] for _ in range(40)]
    rows = None
    for q, tops in enumerate(cases):
        one = expanded(spark, tops, q)
        rows = one if rows is None else rows.unionByName(one)
    got = {}
    for r in retrieve.pack(rows, 12).orderBy("query_id", "rank", "at").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["skip_reason"]))
    assert got == {q: restated(tops, 12) for q, tops in enumerate(cases)}


def test_top_chunks_order(spark):  # noqa: ANN001
    scored = spark.createDataFrame([(1, 0, 0.2), (1, 1, math.nan), (1, 2, 0.9), (1, 3, 0.9)], "query_id long, position int, score double")
    assert [r["position"] for r in retrieve.top_chunks(scored, 3).orderBy("rank").collect()] == [1, 3, 2]
    with pytest.raises(ValueError, match="top_n"):
        retrieve.top_chunks(scored, 0)


def test_cosine(spark):  # noqa: ANN001
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(vector.cosine(F.col("a"), F.col("b")), vector.cosine(F.col("a"), F.col("z"))).first()
    assert got[0] == pytest.approx(1 / math.sqrt(2))
    assert math.isnan(got[1])


def test_index_build(spark):  # noqa: ANN001
    rows = [("d", 0, "chunk", "a", "A", "x", []), ("d", 1, "text", "t", None, "x", None), ("d", 2, "chunk", "b", "B", "  ", []), ("d", 3, "chunk", "c", "C", "y" * 9, ["b", "a", "zzz"])]
    chunks = spark.createDataFrame(rows, "dataset_id string, ord int, kind string, id string, title string, content string, relevantChunksIds array<string>").withColumn("vector", F.array(F.lit(3.0), F.lit(4.0)))
    got = [(r["id"], r["position"], r["relevantChunksIds"], r["num_tokens"], r["norm"]) for r in index.build(chunks).orderBy("position").collect()]
    assert got == [("a", 0, [], 1, 5.0), ("c", 1, ["a"], 3, 5.0)]


def test_prompt(spark):  # noqa: ANN001
    rows = spark.createDataFrame([(1, 1, -1, 5, "t5", "c5"), (1, 1, 0, 2, "t2", "c2")], "query_id long, rank int, at int, position int, title string, content string")
    assert prompt.context(rows, True).first()["context"] == "Titel: t2 \nc2\n\nTitel: t5 \nc5"
    assert prompt.context(rows).first()["context"].startswith("Titel: t5")
    asked = spark.createDataFrame([("d", "q {query_str}", "c {context_str}"), ("e", "q", None)], "dataset_id string, prompt string, context string")
    got = [r["rendered"] for r in prompt.render(asked, {"d": "{context_str}|{query_str}|{{}}"}).orderBy("dataset_id").collect()]
    assert got == ["c {context_str}|q {query_str}|{}", None]
    with pytest.raises(ValueError, match="unknown field"):
        text.fill_template("{other}", F.lit(""), F.lit(""))


def test_conf(spark):  # noqa: ANN001
    spark.conf.set("lodestone.top_n", "25")
    spark.conf.set("lodestone.order_from_source", "true")
    conf = EngineConf.of(spark)
    spark.conf.unset("lodestone.top_n")
    spark.conf.unset("lodestone.order_from_source")
    assert (conf.top_n, conf.order_from_source, conf.budget) == (25, True, 6500)


def test_sources_shape(spark):  # noqa: ANN001
    rows = [(1, 1, "d", "a", "A", "ca", 4, 0, 0.5, [(0, "b", "B", "cb", 9, 1)]), (1, 2, "d", "b", "B", "cb", 9, 1, 0.4, [(0, "a", "A", "ca", 4, 0)])]
    both = spark.createDataFrame(rows, "query_id long, rank int, dataset_id string, id string, title string, content string, num_tokens int, position int, score double, related array<struct<at:int,id:string,title:string,content:string,num_tokens:int,position:int>>")
    got = retrieve.sources(both, retrieve.pack(both, 10)).orderBy("rank").collect()
    assert [(r["skip"], r["skip_reason"], [(c["id"], c["skip_reason"]) for c in r["relevantChunks"]]) for r in got] == [(False, "", [("b", "context_window")]), (True, "context_window", [])]


def counting_model(told=0.5):  # noqa: ANN001, ANN201
    """A vector of the text's length, whether it carries a role, and the size of the call."""

    def load():  # noqa: ANN202
        return lambda texts: ([[float(len(t)), float(t.startswith(("passage: ", "query: "))), float(len(texts))] for t in texts], told)

    return load


def test_embedding_by_a_model(spark):  # noqa: ANN001
    rows = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(24)], "ord long, content string").coalesce(1)
    got = embed.embedded(rows, counting_model(), "multilingual-e5-large").orderBy("ord").collect()
    assert [r["vector"] and r["vector"][:2] for r in got] == [None if i == 3 else [i + 9.0, 1.0] for i in range(24)]
    assert [r["vector"][2] for r in got if r["vector"]] == [10.0] * 20 + [3.0] * 3
    assert [r["ord"] for r in got if r["seconds"]] == [0, 11, 21]
    assert sum(r["seconds"] for r in got) == 1.5


def test_embedding_of_queries_and_of_nothing(spark):  # noqa: ANN001
    rows = spark.createDataFrame([(1, "ab", [9.0])], "query_id long, prompt string, vector array<double>")
    plain = embed.embedded(rows, counting_model(told=0.0), "other", "query", content="prompt").first()
    assert plain["vector"] == [2.0, 0.0, 1.0] and plain["seconds"] > 0  # an older vector is replaced; the call is timed here
    assert embed.embedded(rows, counting_model(), "multilingual-e5", "query", content="prompt").first()["vector"] == [9.0, 1.0, 1.0]
    assert embed.embedded(rows.limit(0), counting_model(), "other", content="prompt").collect() == []


def test_embedding_wants_a_vector_for_each_text(spark):  # noqa: ANN001
    rows = spark.createDataFrame([("a",), ("b",)], "content string").coalesce(1)
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        embed.embedded(rows, lambda: lambda texts: ([[1.0]], 0.0), "other").collect()
