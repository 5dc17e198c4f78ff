"""The functions of Spark SQL against those of the DataFrame API."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone import sql
from lodestone.functions import numbers, text, vector


def test_functions(spark: SparkSession) -> None:
    assert "lodestone_cosine" in sql.register(spark)
    rows = [("﻿ 　a\x1c ", [1.0, 2.0], [2.0, 1.0], 3), ("", [0.0], [1.0], 0), (None, None, [1.0], None), ("x" * 151, [1.0], [1.0, 2.0], 1), ("'\\ \"", [], [], 2)]
    table = spark.createDataFrame(rows, "s string, a array<double>, b array<double>, n long")
    table.createOrReplaceTempView("some_rows")
    got = spark.sql("SELECT lodestone_py_strip(s), lodestone_js_trim(s), lodestone_is_blank(s), lodestone_preview(s), lodestone_vector_norm(a), lodestone_cosine(a, b), lodestone_queue_seconds(n), lodestone_approx_tokens(s), lodestone_kwh(n, 7) FROM some_rows").collect()
    s, a, b, n = (F.col(c) for c in "sabn")
    expected = table.select(text.py_strip(s), text.js_trim(s), text.is_blank(s), text.preview(s), vector.norm(a), vector.cosine(a, b), numbers.queue_seconds(n), text.approx_tokens(s), numbers.kwh(n.cast("double"), F.lit(7.0))).collect()
    plain = lambda r: [None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else v for v in r]
    assert [plain(r)[:6] for r in got] == [plain(r)[:6] for r in expected]
    assert [plain(r)[7:] for r in got] == [plain(r)[7:] for r in expected]
    assert [r[6] for r in got if r[8] is not None] == [r[6] for r in expected if r[8] is not None]


def test_lines_of_a_chunk(spark: SparkSession) -> None:
    sql.register(spark)
    lines = "array(named_struct('line', 'a', 'de', 'a b', 'en', 'A B'), named_struct('line', 'b', 'de', null, 'en', null), named_struct('line', 'z', 'de', null, 'en', null))"
    got = spark.sql(f"SELECT t.* FROM VALUES (1) AS c(i), LATERAL lodestone_align_lines({lines}) AS t ORDER BY seq").collect()
    assert [tuple(r) for r in got] == [(0, "a b", "A B", True), (1, "z", "", False)]
