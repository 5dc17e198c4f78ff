"""Exact top-k search by inner product: ball trees, branch and bound.

Vectors are dealt into shards of near ones: the signs of a few fixed projections name a cell, and a cell with many
vectors is divided by a hash of the id. Each shard's ball tree is built once and written as one row. A search visits,
inside a tree, balls in the order of their upper bound q.c + |q|r, and leaves out those whose bound is below the k-th
best score known so far. That score is shared in two rounds: in the first each query searches the shard whose root
promises most, in the second it brings the k-th score found there to every other shard that can still reach it.

Queries meet shards in blocks against pages of roots, and only what can still win is sent on to a shard: neither side
is ever whole in one task, and no row stands for one query and one shard that can't help it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tidy

FOUND = "query_id long, vec_id long, score long"
TREE = "shard long, dim int, center binary, radius binary, rows binary, ids array<long>, root array<double>, reach double"


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, vector of floor(scale * x)); rows whose vector is null or empty, or holds a null or a component that isn't finite, and rows without an id take no part.

    Rows that repeat count once; of different vectors under one id the smallest counts.
    """
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))


class BallTree:
    """Balls in an array, children of i at 2i+1 and 2i+2; the rows of each are a range that halves with each level."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, center: np.ndarray, radius: np.ndarray) -> None:
        """Of parts that are in order, as `built` leaves them or as they were stored."""
        self.ids, self.rows, self.center, self.radius = ids, rows, center, radius
        self.lo, self.hi = self.ranges(len(ids), len(radius))
        self.first_leaf = len(radius) // 2

    @staticmethod
    def ranges(n: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.zeros(nodes, int), np.zeros(nodes, int)
        hi[0] = n
        for i in range(nodes // 2):
            mid = (lo[i] + hi[i]) // 2
            lo[2 * i + 1], hi[2 * i + 1], lo[2 * i + 2], hi[2 * i + 2] = lo[i], mid, mid, hi[i]
        return lo, hi

    @classmethod
    def built(cls, ids: np.ndarray, rows: np.ndarray, leaf: int) -> BallTree:
        levels = max(0, math.ceil(math.log2(max(1, len(ids) / leaf))))
        nodes = (1 << (levels + 1)) - 1
        lo, hi = cls.ranges(len(ids), nodes)
        center, radius = np.zeros((nodes, rows.shape[1])), np.zeros(nodes)
        order = np.arange(len(ids))
        for i in range(nodes):
            own = order[lo[i] : hi[i]]
            if not len(own):
                continue
            center[i] = rows[own].mean(0)
            far = ((rows[own] - center[i]) ** 2).sum(1)
            radius[i] = np.sqrt(far.max())
            if i < nodes // 2:  # cut at the median along the line from one far row to the farthest from it
                a = own[far.argmax()]
                b = own[((rows[own] - rows[a]) ** 2).sum(1).argmax()]
                order[lo[i] : hi[i]] = own[np.argsort(rows[own] @ (rows[b] - rows[a]), kind="stable")]
        return cls(ids[order], rows[order], center, radius)

    def search(self, query: np.ndarray, own_id: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) that reach floor, from the ball with the highest bound on."""
        bound = upper(query[None], self.center, self.radius)[0]
        best: list[tuple[int, int]] = []
        heap = [(-bound[0], 0)]
        while heap:
            b, i = heapq.heappop(heap)
            if -b < floor:
                break
            if i < self.first_leaf:
                for j in (2 * i + 1, 2 * i + 2):
                    if self.hi[j] > self.lo[j] and bound[j] >= floor:
                        heapq.heappush(heap, (-bound[j], j))
                continue
            part = slice(self.lo[i], self.hi[i])
            score = self.rows[part] @ query
            for s, v in zip(score[(hit := score >= floor)].astype(int).tolist(), self.ids[part][hit].tolist(), strict=True):
                if v != own_id:
                    heapq.heappush(best, (s, -v))
                    if len(best) > k:
                        heapq.heappop(best)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def upper(queries: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What each query's score with a row of each ball can reach, a little more than exact: rounding must not hide a tie."""
    bound = queries @ centers.T + np.sqrt((queries**2).sum(1))[:, None] * radii
    return bound + 1e-9 * np.abs(bound) + 1e-3


def _cell(bits: int) -> Column:
    """The signs of fixed projections of `vector` as one number."""

    def sign(bit: Column) -> Column:
        signed = F.transform("vector", lambda x, i: F.when(F.xxhash64(i, bit) % 2 == 0, x).otherwise(-x))
        return F.when(F.aggregate(signed, F.lit(0).cast("long"), lambda s, x: s + x) > 0, 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), F.lit(0).cast("long"), lambda s, b: s * 2 + sign(b)) if bits else F.lit(0).cast("long")


def _dealt(rows: DataFrame, n: int, shard_rows: int) -> DataFrame:
    """rows with (shard, dim). There are at most twice n / shard_rows cells and about as many divisions of them."""
    celled = rows.withColumn("dim", F.size("vector")).withColumn("cell", _cell(max(0, (n // shard_rows).bit_length() - 1)))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    return celled.join(sizes, "cell").withColumn("shard", F.xxhash64("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")))).select("vec_id", "vector", "dim", "shard")


def _trees(dealt: DataFrame, leaf: int) -> DataFrame:
    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree.built(group["vec_id"].to_numpy(), np.array(group["vector"].tolist(), dtype=np.float64), leaf)
        parts = [group["shard"].iloc[0], tree.rows.shape[1], tree.center.tobytes(), tree.radius.tobytes(), tree.rows.tobytes(), tree.ids, tree.center[0], tree.radius[0]]
        return pd.DataFrame([parts], columns=["shard", "dim", "center", "radius", "rows", "ids", "root", "reach"])

    return dealt.groupBy("shard", "dim").applyInPandas(build, TREE)


def _list(column: pa.Array, i: int, of: type) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False).astype(of, copy=False)


def _visit(trees: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """FOUND, from asking: (shard, dim, query_ids, vectors one after the other, floors). A task holds one tree, and what asks of it passes by."""
    of_tree = trees.select("shard", "dim", F.lit(0).alias("kind"), "center", "radius", "rows", "ids").join(asking.select("shard", "dim").distinct(), ["shard", "dim"], "left_semi")
    both = of_tree.unionByName(asking.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            at, out = {name: batch.column(name) for name in batch.schema.names}, []
            for i in range(batch.num_rows):
                if at["kind"][i].as_py() == 0:
                    dim = at["dim"][i].as_py()
                    matrix = {name: np.frombuffer(at[name][i].as_buffer(), np.float64) for name in ("rows", "center", "radius")}
                    tree = BallTree(_list(at["ids"], i, np.int64), matrix["rows"].reshape(-1, dim), matrix["center"].reshape(-1, dim), matrix["radius"])
                    continue
                ids, floors = _list(at["query_ids"], i, np.int64).tolist(), _list(at["floors"], i, np.float64).tolist()
                for q, v, floor in zip(ids, _list(at["vectors"], i, np.float64).reshape(len(ids), -1), floors, strict=True):
                    out += [(q, -j, s) for s, j in tree.search(v, q, k, floor)]
            found = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(3)], names=["query_id", "vec_id", "score"])

    return both.repartition("shard", "dim").sortWithinPartitions("shard", "dim", "kind").mapInArrow(tidy(run), FOUND)


def _meeting(blocks: DataFrame, trees: DataFrame, n_blocks: int, n_pages: int) -> DataFrame:
    """Each block of queries with each page of shards' roots of its dimension: a row for a block and a page."""
    root = F.struct("shard", "root", "reach")
    pages = trees.withColumn("page", F.pmod(F.xxhash64("shard", F.lit(2)), F.lit(n_pages))).groupBy("page", "dim").agg(F.collect_list(root).alias("roots"))
    spread = pages.select("dim", F.col("roots.shard").alias("shards"), F.flatten("roots.root").alias("centers"), F.col("roots.reach").alias("radii"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    return blocks.join(spread, ["block", "dim"])


def _bounds(at: dict[str, pa.Array], i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, shards, bounds of each vector in each shard) of a row of a meeting."""
    dim = at["dim"][i].as_py()
    vectors = _list(at["vectors"], i, np.float64).reshape(-1, dim)
    return _list(at["query_ids"], i, np.int64), vectors, _list(at["shards"], i, np.int64), upper(vectors, _list(at["centers"], i, np.float64).reshape(-1, dim), _list(at["radii"], i, np.float64))


def _promises(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each query of a meeting the shard of the page that promises most."""
    for batch in batches:
        at = {name: batch.column(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            ids, _, shards, bound = _bounds(at, i)
            most = bound.argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bound[np.arange(len(ids)), most]), pa.array(shards[most])], names=["query_id", "bound", "shard"])


def _chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard of a page the queries of the block that can still win there; a shard that none can reach gives no row."""
    names = ["shard", "dim", "query_ids", "vectors", "floors"]
    for batch in batches:
        at = {name: batch.column(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            ids, vectors, shards, bound = _bounds(at, i)
            floors = _list(at["floors"], i, np.float64)
            open_ = (bound >= floors[:, None]) & (_list(at["firsts"], i, np.int64)[:, None] != shards)
            for j in np.flatnonzero(open_.any(0)):
                q = open_[:, j]
                values = [[shards[j]], [vectors.shape[1]], [ids[q]], [vectors[q].astype(np.int64).ravel()], [floors[q]]]
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=names)


ASKING = "shard long, dim int, query_ids array<long>, vectors array<long>, floors array<double>"


def search(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = 16384, block_rows: int = 1024, page_shards: int = 1024, leaf: int = 64, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k other rows with the highest integer inner product, ties to the smaller vec_id; all others if fewer.

    A vector meets only vectors of its own length. An empty table gives no rows. Scores are exact while their sums stay below 2**53.
    shard_rows, block_rows and page_shards bound the vectors of a tree, the queries of a block and the roots of a page (about: a hash deals them).
    """
    rows = materialise(quantised(vectors, scale))
    n = rows.count()
    trees = materialise(_trees(_dealt(rows, n, shard_rows), leaf))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dim"))
    n_blocks, n_pages = max(1, -(-queries.count() // block_rows)), max(1, -(-trees.count() // page_shards))

    def blocks(queries_: DataFrame, *more: str) -> DataFrame:
        by = queries_.groupBy(F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(n_blocks)).alias("block"), "dim")
        return by.agg(F.collect_list(F.struct("query_id", "vector", *more)).alias("q")).select("block", "dim", F.col("q.query_id").alias("query_ids"), F.flatten("q.vector").alias("vectors"), *[F.col(f"q.{name}").alias(f"{name}s") for name in more])

    promised = _meeting(blocks(queries), trees, n_blocks, n_pages).mapInArrow(tidy(_promises), "query_id long, bound double, shard long")
    first = materialise(promised.groupBy("query_id").agg(F.max_by("shard", F.struct("bound", "shard")).alias("first")).join(queries, "query_id"))
    no_floor = F.lit(float("-inf"))
    start = materialise(_visit(trees, first.select(F.col("first").alias("shard"), "dim", F.array("query_id").alias("query_ids"), F.col("vector").alias("vectors"), F.array(no_floor).alias("floors")), k))
    kth = start.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(no_floor).alias("floor"))
    told = first.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", no_floor))
    chances = materialise(_meeting(blocks(told, "floor", "first"), trees, n_blocks, n_pages).mapInArrow(tidy(_chances), ASKING))
    found = start.unionByName(_visit(trees, chances, k))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
