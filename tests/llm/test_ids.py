"""Ids that are missing, or stand on several rows."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession

from lodestone.llm import jaccard_join

from .test_operators import components_by_force


def test_components_of_rows_without_ids_of_their_own(spark: SparkSession) -> None:
    """Rows are linked by their texts alone, whatever ids they share or lack."""
    random.seed(31)
    text = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    x, y, z = text(60), text(60), text(60)
    rows = [(5, x), (5, y), (2, y + " more"), (7, x), (None, z), (None, text(60)), (None, z + " more"), (9, z + " more and more"), (None, None), (5, None), (5, "")]
    for _ in range(40):  # near copies under ids drawn from a few
        words = text(50).split()
        for _ in range(3):
            words[random.randrange(50)] = "other"
            rows.append((random.choice([None, 5, *range(100, 120)]), " ".join(words)))
    n = len(rows)
    config = jaccard_join.Config()
    force = {i: (size, part) for i, size, part in components_by_force(list(enumerate(t for _, t in rows)), config)}
    least = {part: min((rows[i][0] for i in range(n) if force[i][1] == part and rows[i][0] is not None), default=None) for _, part in force.values()}
    expected = sorted((str(rows[i][0]), force[i][0], str(least[force[i][1]])) for i in range(n))
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), config).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == expected
    assert [r["component_id"] for r in got if r["doc_id"] == 7] == [5]
    assert 9 in {r["component_id"] for r in got if r["doc_id"] is None}
