"""Work dealt into blocks gives what it gives in one piece: numbering, lines of files, scoring."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vector
from lodestone.operators import index, retrieve
from lodestone.sources import readers, shared


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_numbering(spark: SparkSession, block: int) -> None:
    random.seed(4)
    rows = [(random.choice(["a", "b", None]), ord_, "x") for ord_ in random.sample(range(-50, 300), 200)] + [("a", None, "first")]
    got = index.numbered(spark.createDataFrame(rows, "dataset_id string, ord long, other string").repartition(3), block).collect()
    for dataset in ("a", "b", None):
        own = sorted((r[1] for r in rows if r[0] == dataset), key=lambda x: (x is not None, x or 0))
        assert {r["ord"]: r["position"] for r in got if r["dataset_id"] == dataset} == {o: n for n, o in enumerate(own)}
    assert index.numbered(spark.createDataFrame([], "dataset_id string, ord long"), block).collect() == []


def test_a_data_set_is_numbered_in_several_tasks(spark: SparkSession) -> None:
    rows = spark.range(1000).select(F.lit("a").alias("dataset_id"), F.col("id").alias("ord"))
    spread = index.numbered(rows, 10).select(F.spark_partition_id().alias("p")).distinct()
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert spread.count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)


def test_lines_of_files_in_splits(spark: SparkSession, tmp_path: Path) -> None:
    random.seed(1)
    expected = {}
    for k, (n, end) in enumerate([(3000, "\n"), (1, ""), (200, "\n"), (0, "")]):
        lines = ["".join(random.choices("ab é\r", k=random.randint(0, 30))) for _ in range(n)]
        (tmp_path / f"{k}.txt").write_bytes(("\n".join(lines) + end).encode())
        expected |= {(f"{k}.txt", i): x for i, x in enumerate(lines)}
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c in held:
        spark.conf.set(c, "2k")
    try:
        lines = readers.lines(spark, str(tmp_path))
        assert {(Path(r["path"]).name, r["line_no"]): r["text"] for r in lines.collect()} == expected
        assert spark.read.text(str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 5
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)


def test_scoring_in_blocks(spark: SparkSession) -> None:
    """Nulls, vectors of another length or without one, NaN and ties rank as they do pair by pair."""
    random.seed(5)
    odd = [None, [1.0, None, 2.0], [1.0, 2.0], [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0], []]
    vectors = lambda n: [random.choice(odd) if random.random() < 0.2 else [float(random.randint(-1, 1)) for _ in range(3)] for _ in range(n)]
    chunks = spark.createDataFrame([("a", i, v) for i, v in enumerate(vectors(60))] + [("b", i, v) for i, v in enumerate(vectors(9))] + [("unasked", 0, [1.0, 1.0, 1.0])], "dataset_id string, position int, vector array<double>").withColumn("norm", vector.norm(F.col("vector")))
    queries = spark.createDataFrame([(f"q{i}", random.choice(["a", "a", "b", "unknown", None]), v) for i, v in enumerate(vectors(40))], "query_id string, dataset_id string, query_vector array<double>")
    plain = retrieve.top_chunks(retrieve.score(queries, chunks).withColumn("score", F.round("score", 6)), 5)
    told = lambda df: sorted(str((r["query_id"], r["rank"], r["position"], r["score"])) for r in df.collect())
    expected = told(plain)
    assert len(expected) > 80
    for sizes in ({}, {"chunk_block": 7, "query_block": 3}):
        assert told(retrieve.top(queries, chunks, 5, places=6, **sizes)) == expected
    found = retrieve.winners(retrieve.top(queries, chunks, 5, places=6), chunks)
    assert told(found) == expected
    assert {"vector", "norm", "dataset_id"} <= set(found.columns)
    assert retrieve.top(queries.limit(0), chunks, 5).collect() == []
    with pytest.raises(ValueError, match="top_n"):
        retrieve.top(queries, chunks, 0)


def test_blank_texts(spark: SparkSession) -> None:
    from lodestone.functions import text

    rows = [(t,) for t in ["", " \n\t", " 　", " a ", "a", "​", None, " " * 50_000 + "x"]]
    got = spark.createDataFrame(rows, "t string").select(text.is_blank(F.col("t")), text.py_strip(F.col("t")) == "").collect()
    assert [r[0] for r in got] == [r[1] for r in got] == [True, True, True, False, False, False, None, False]


def test_written_tables(spark: SparkSession) -> None:
    table = spark.createDataFrame([(1, None), (2, [1.0])], "a int, b array<double>")
    back = shared.written(table)
    assert sorted(back.collect()) == sorted(table.collect())
    assert back.schema == table.schema


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_prefix_match_over_ranges(spark: SparkSession, ranges: int) -> None:
    """Intervals of references that begin alike, over one range or many."""
    from lodestone.operators import align

    random.seed(6)
    refs = [(random.randint(0, 10_000), "same beginning " * 3 + "".join(random.choices("abé", k=random.randint(0, 6)))) for _ in range(600)]
    refs += [(random.randint(0, 10_000), "".join(random.choices("ab ", k=random.randint(0, 5)))) for _ in range(50)] + [(3, None), (None, "unnumbered")]
    lines = ["", None, "same", "same beginning", "same beginning " * 3, "same beginning " * 4, "unnumbered", "zz", "b", "\U0001f600"]
    lines += [r[: random.randint(0, len(r))] for _, r in refs if r is not None for _ in range(2)]
    expected = [(x, min((n for n, r in refs if x is not None and r is not None and n is not None and r.startswith(x)), default=None)) for x in lines]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = align.first_prefix_match(spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame(refs, "line_no long, ref string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sorted(map(str, ((r["line"], r["line_no"]) for r in got))) == sorted(map(str, expected))


def test_white_space_at_the_ends(spark: SparkSession) -> None:
    """As str.strip() has it; String.trim() has the byte-order mark, but no separators of files, groups, records and units."""
    from lodestone.functions import text

    ends = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if c.isspace() or c in "﻿​᠎"] + ["x"]
    rows = [(f"{c}{c} a{c}b {c}", f"{c}{c} a{c}b {c}".strip()) for c in ends] + [("", ""), (" \n　", ""), ("a" * 1000 + " ", "a" * 1000)]
    got = spark.createDataFrame(rows, "t string, expected string").select(text.py_strip(F.col("t")), "expected", text.js_trim(F.col("t")), text.normalize_spaces(F.col("t")), "t").collect()
    assert all(r[0] == r[1] for r in got)
    assert all(r[3] == " ".join(r[4].split()) for r in got)
    assert all(r[2] == r[4].strip("".join({*map(chr, range(0x3001))} & {c for c in map(chr, range(0x3001)) if c.isspace()} - set("\x1c\x1d\x1e\x1f\x85")) + "﻿") for r in got)


def test_alignment_holds_few_lines() -> None:
    """Lines are walked as they come, and neither what is read nor what is sent on grows with them."""
    from itertools import cycle, islice

    import pyarrow as pa

    from lodestone.operators import align

    own = [("A", "A B C", "E"), ("", None, None), ("B", None, None), ("Q", None, None)]
    endless = ({"line": line, "de": de, "en": en} for line, de, en in cycle(own))
    assert list(islice(align.walk(endless), 5)) == [("A B C", "E", True), ("B", "", False), ("Q", "", False), ("A B C", "E", True), ("B", "", False)]
    taken = 0

    def batches():  # noqa: ANN202
        nonlocal taken
        while True:
            taken += 1
            yield pa.RecordBatch.from_pydict({"a": ["x" * 100_000] * 100, "n": list(range(100))})

    first = next(align._batches(align._rows(batches(), "a", "n"), pa.schema([("a", pa.string()), ("n", pa.int64())])))
    assert taken == 1 and first.num_rows == 11 and first.column("n").to_pylist() == list(range(11))


def test_all_scores_in_blocks(spark: SparkSession) -> None:
    """Every pair, as it is scored one by one, whatever the vectors."""
    random.seed(8)
    odd = [None, [1.0, None, 2.0], [1.0, 2.0], [0.0, 0.0, 0.0], []]
    vectors = lambda n: [random.choice(odd) if random.random() < 0.2 else [float(random.randint(-1, 1)) for _ in range(3)] for _ in range(n)]
    chunks = spark.createDataFrame([(d, i, f"{d}{i}", v) for d, n in (("a", 40), ("b", 9)) for i, v in enumerate(vectors(n))], "dataset_id string, position int, id string, vector array<double>").withColumn("norm", vector.norm(F.col("vector")))
    queries = spark.createDataFrame([(i, random.choice(["a", "b", "unknown", None]), v) for i, v in enumerate(vectors(30))], "query_id long, dataset_id string, query_vector array<double>")
    told = lambda df: sorted(str(tuple(r)) for r in df.select("query_id", "id", F.round("score", 6)).collect())
    expected = told(retrieve.score(queries, chunks))
    assert len(expected) > 300
    for sizes in ({}, {"chunk_block": 7, "query_block": 3}):
        assert told(retrieve.scores(queries, chunks, **sizes)) == expected
