"""Vectors of texts from a model that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Takes some texts and gives a vector for each, and the seconds that it took by its own account (0: not told).
Embedder = Callable[[list[str]], tuple[list[list[float]], float]]


def _batch(model: Embedder, texts: list[str]) -> tuple[list[list[float]], float]:
    """A call of the model, timed here if it doesn't say itself how long it took."""
    begun = pd.Timestamp.now()
    vectors, seconds = model(texts)
    if len(vectors) != len(texts):
        raise ValueError(f"the model gave {len(vectors)} vectors for {len(texts)} texts")
    return vectors, seconds or (pd.Timestamp.now() - begun).total_seconds()


def embedded(rows: DataFrame, load: Callable[[], Embedder], name: str, role: str = "passage", size: int = 10, content: str = "content") -> DataFrame:
    """rows with vector and seconds (a call's time stands with the first of its texts, 0 with the others, so that sums hold).

    load is called once a task and gives the model; name decides whether texts carry their role (passage or query) in
    front. Each call gets at most `size` texts. Null texts get no vector and aren't sent.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            vectors: list[list[float] | None] = [None] * len(part)
            seconds = [0.0] * len(part)
            sent = [i for i, t in enumerate(part) if t is not None]
            for k in range(0, len(sent), size):
                at = sent[k : k + size]
                found, seconds[at[0]] = _batch(model, [part.iloc[i] for i in at])
                for i, v in zip(at, found, strict=True):
                    vectors[i] = v
            yield pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "seconds": seconds})

    called = F.pandas_udf(run, "vector array<double>, seconds double")
    made = rows.withColumn("_embedded", called(text.embedding_text(F.col(content), role, name)))
    return made.withColumn("vector", F.col("_embedded.vector")).withColumn("seconds", F.col("_embedded.seconds")).drop("_embedded")
