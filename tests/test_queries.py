"""Every query that has SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from lodestone.plans import corpus, live, retrieval, shown

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("LODESTONE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = {**retrieval.QUERIES, **corpus.QUERIES, **live.QUERIES, **shown.QUERIES}, {**retrieval.SQL, **corpus.SQL, **live.SQL, **shown.SQL}
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


def plain(value):  # noqa: ANN001, ANN201
    if isinstance(value, float) and value != value:
        return "NaN"
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():  # noqa: ANN201
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):  # noqa: ANN001
    own = QUERIES[name](spark, DATA)
    columns = sorted(own.columns)
    there = duck.sql(SQL[name])
    assert columns == sorted(there.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in own.collect()), key=repr)
    theirs = sorted((tuple(map(plain, r)) for r in there.select(*columns).fetchall()), key=repr)
    assert rows == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):  # noqa: ANN001
    assert QUERIES[name](spark, DATA).count() > 0
