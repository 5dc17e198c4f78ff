"""Retrieval: score, rank, add related chunks, fit a token budget."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..conf import EngineConf
from ..functions import numbers, text, vector


ADMITTED, DUPLICATE, NO_ROOM = "", "duplicate", "context_window"


def of_query() -> WindowSpec:
    return Window.partitionBy("query_id")


def score(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each query (query_id, dataset_id, query_vector) with every chunk of its data set. It is an equi-join on the data set; norms come from the store."""
    q = queries.withColumn("query_norm", vector.norm(F.col("query_vector")))
    return q.join(chunks, "dataset_id").withColumn("score", vector.cosine(F.col("query_vector"), F.col("vector"), F.col("query_norm"), F.col("norm")))


#: Chunks and queries of a data set that one task multiplies.
CHUNK_BLOCK, QUERY_BLOCK = 4096, 1024


def _vectors(vectors: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The dimension of each vector, -1 where it is null or holds null, and a matrix of those of each dimension."""
    lists = vectors.combine_chunks()
    flat = pc.list_flatten(lists)
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(np.maximum(sizes, 0))
    nulls = np.concatenate([[0], np.cumsum(pc.is_null(flat).to_numpy(zero_copy_only=False))])
    dims = np.where(nulls[ends] == nulls[ends - np.maximum(sizes, 0)], sizes, -1)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return dims, {int(d): values[(ends[dims == d] - d)[:, None] + np.arange(d)] for d in np.unique(dims) if d >= 0}


def _scores(queries: pa.ChunkedArray, chunks: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of every query with every chunk, and where there is none, as vector.cosine has it."""
    (q_dims, q_of), (c_dims, c_of) = _vectors(queries), _vectors(chunks)
    norms = []
    for dims, of in ((q_dims, q_of), (c_dims, c_of)):
        own = np.full(len(dims), np.nan)
        for d, m in of.items():
            own[dims == d] = np.sqrt((m * m).sum(1))
        norms.append(own)
    size = norms[0][:, None] * norms[1][None, :]
    score = np.full(size.shape, np.nan)
    for d in q_of.keys() & c_of.keys():
        score[np.ix_(q_dims == d, c_dims == d)] = q_of[d] @ c_of[d].T
    score /= size
    known = (q_dims >= 0)[:, None] & (c_dims >= 0)[None, :]
    score[known & (size == 0)] = np.nan
    return score, ~(known & ((q_dims[:, None] == c_dims[None, :]) | (size == 0)))


def _best(queries: pa.Table, chunks: pa.Table, top_n: int, places: int | None) -> pa.Table:
    """The top_n of a block of chunks for each of a block of queries."""
    position = chunks.column("position").to_numpy()
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        score, none = _scores(queries.column("query_vector"), chunks.column("vector"))
        if places is not None:
            score = np.round(score, places)
    # As Spark sorts from the top: what isn't a number, numbers, nothing.
    key = np.where(np.isnan(score), np.inf, score)
    key[none] = -np.inf
    n = min(top_n, len(position))
    least = np.partition(key, len(position) - n, axis=1)[:, len(position) - n]
    row, col = np.nonzero(key >= least[:, None])
    order = np.lexsort((-position[col], -key[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < n
    row, col = row[kept], col[kept]
    values = pa.array(score[row, col], mask=none[row, col])
    take = lambda name, at: queries.column(name).combine_chunks().take(pa.array(at))
    return pa.table({"query_id": take("query_id", row), "dataset_id": take("dataset_id", row), "position": pa.array(position[col].astype(np.int32)), "score": values})


def top(queries: DataFrame, chunks: DataFrame, top_n: int, places: int | None = None, chunk_block: int = CHUNK_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, dataset_id, position, score, rank): the same as top_chunks(score()), by position in the data set, without a row for each pair.

    Chunks of a data set (dataset_id, position, vector) are dealt into blocks of positions and its queries (query_id,
    dataset_id, query_vector) into blocks by a hash; each block meets each once, as the product of two matrices, and only
    its top_n of every query go on. So a data set of any size spreads over tasks, and of vectors and numbers alone.
    places: scores are rounded before they are ranked. Scores are those of vector.cosine: null with a vector that is
    null, holds null or has another dimension, which comes last; NaN comes first.
    """
    if top_n < 1:
        raise ValueError("top_n must be 1 or more")
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, dataset_id string, position int, score double"
    met = _blocks(queries, chunks, lambda q, c: _best(q, c, top_n, places), schema, ["position"], chunk_block, query_block)
    return top_chunks(met, top_n)


def _blocks(queries: DataFrame, chunks: DataFrame, found: Callable[[pa.Table, pa.Table], pa.Table], schema: str, columns: list[str], chunk_block: int, query_block: int) -> DataFrame:
    """What found() makes of each block of a data set's queries with each block of its chunks (vector and columns)."""
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    of_queries = queries.groupBy("dataset_id").agg(F.ceil(F.count("*") / query_block).alias("n_query_blocks"))
    of_chunks = chunks.groupBy("dataset_id").agg((F.floor(F.max("position") / chunk_block) + 1).alias("n_chunk_blocks"))
    sizes = of_queries.join(of_chunks, "dataset_id")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = queries.select("dataset_id", "query_id", F.col("query_vector").cast("array<double>").alias("query_vector")).join(sizes, "dataset_id")
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.col("n_query_blocks"))).withColumn("chunk_block", upto("n_chunk_blocks")).drop("n_query_blocks", "n_chunk_blocks")
    held = chunks.select("dataset_id", *columns, F.floor(F.col("position") / chunk_block).alias("chunk_block"), F.col("vector").cast("array<double>").alias("vector")).join(sizes, "dataset_id")
    held = held.withColumn("query_block", upto("n_query_blocks")).drop("n_query_blocks", "n_chunk_blocks")
    block = ["dataset_id", "query_block", "chunk_block"]
    return asked.groupBy(*block).cogroup(held.groupBy(*block)).applyInArrow(lambda q, c: found(q, c) if q.num_rows and c.num_rows else empty, schema)


def _all(queries: pa.Table, chunks: pa.Table) -> pa.Table:
    """Every query of a block with every chunk of another."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        score, none = _scores(queries.column("query_vector"), chunks.column("vector"))
    row, col = np.divmod(np.arange(score.size), max(1, score.shape[1]))
    take = lambda table, name, at: table.column(name).combine_chunks().take(pa.array(at))
    return pa.table({"query_id": take(queries, "query_id", row), "id": take(chunks, "id", col), "score": pa.array(score.ravel(), mask=none.ravel())})


def scores(queries: DataFrame, chunks: DataFrame, chunk_block: int = 1024, query_block: int = 256) -> DataFrame:
    """(query_id, id, score): the same as score() of chunks (dataset_id, position, id, vector), as products of matrices. It has a row for each pair, so its work is that of its result; a task holds a block at a time."""
    id_type = queries.schema["query_id"].dataType.simpleString()
    return _blocks(queries, chunks, _all, f"query_id {id_type}, id string, score double", ["id"], chunk_block, query_block)


def winners(best: DataFrame, chunks: DataFrame) -> DataFrame:
    """What top() found, with the other columns of its chunks; contents move for these alone."""
    found = best.select("query_id", "rank", "score", F.col("dataset_id").alias("of_dataset"), F.col("position").alias("of_position"))
    return found.join(chunks, (F.col("of_dataset") == F.col("dataset_id")) & (F.col("of_position") == F.col("position"))).drop("of_dataset", "of_position")


def top_chunks(scored: DataFrame, top_n: int) -> DataFrame:
    """The top_n by score, NaN first, ties to the later position."""
    if top_n < 1:
        raise ValueError("top_n must be 1 or more")
    ranked = scored.withColumn("rank", F.row_number().over(of_query().orderBy(F.desc("score"), F.desc("position"))))
    return ranked.where(F.col("rank") <= top_n)


def expand(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """related: the related chunks of each, in order, repeats and all; of chunks that share an id the first counts, an unknown id has an empty title and content."""
    first = chunks.groupBy(F.col("dataset_id").alias("of_dataset"), F.col("id").alias("of_id")).agg(F.min_by(F.struct("title", "content", "position", "num_tokens"), "position").alias("found"))
    each = top.select("query_id", "rank", "dataset_id", F.posexplode("relevantChunksIds").alias("at", "related_id"))
    met = each.join(first, (F.col("dataset_id") == F.col("of_dataset")) & (F.col("related_id") == F.col("of_id")), "left")
    known = F.struct(
        F.col("at"),
        F.col("related_id").alias("id"),
        text.or_else(F.coalesce("found.title", F.lit("")), F.col("related_id")).alias("title"),
        F.coalesce("found.content", F.lit("")).alias("content"),
        F.coalesce("found.num_tokens", F.lit(0)).alias("num_tokens"),
        F.coalesce("found.position", F.lit(-1)).alias("position"),
    )
    lists = met.groupBy(F.col("query_id").alias("q"), F.col("rank").alias("r")).agg(F.array_sort(F.collect_list(known)).alias("related"))
    none = F.array().cast("array<struct<at:int,id:string,title:string,content:string,num_tokens:int,position:int>>")
    return top.join(lists, (F.col("query_id") == F.col("q")) & (F.col("rank") == F.col("r")), "left").drop("q", "r").withColumn("related", F.coalesce("related", none))


def _verdict(state: Column, id_: Column, tokens: Column, limit: int) -> Column:
    """Once something found no room, nothing later does; then come repeats; then the budget."""
    room = state["total"] + tokens <= limit
    return F.when(state["full"], NO_ROOM).when(F.array_contains(state["added"], id_), DUPLICATE).when(room, ADMITTED).otherwise(NO_ROOM)


def _after(state: Column, id_: Column, tokens: Column, verdict: Column, row: Column) -> Column:
    admitted = verdict == ADMITTED
    return F.struct(
        (state["total"] + F.when(admitted, tokens).otherwise(0)).alias("total"),
        (state["full"] | (verdict == NO_ROOM)).alias("full"),
        F.when(admitted, F.array_append(state["added"], id_)).otherwise(state["added"]).alias("added"),
        F.array_append(state["out"], row).alias("out"),
    )


OUT = "array<struct<rank:int,at:int,id:string,num_tokens:bigint,skip:boolean,skip_reason:string>>"


def pack(expanded: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, at, id, num_tokens, skip, skip_reason): a row for each top chunk (at = -1) and, where it is admitted, for each of its related chunks.

    It is a fold over one query's chunks in order, at most top_n and their related, which is a list of known size.
    """

    def one(state: Column, rank: Column, at: Column, id_: Column, tokens: Column) -> Column:
        verdict = _verdict(state, id_, tokens, limit)
        row = F.struct(rank.alias("rank"), at.alias("at"), id_.alias("id"), tokens.alias("num_tokens"), (verdict != ADMITTED).alias("skip"), verdict.alias("skip_reason"))
        return _after(state, id_, tokens, verdict, row)

    def step(state: Column, top: Column) -> Column:
        own = one(state, top["rank"], F.lit(-1), top["id"], top["num_tokens"])
        with_related = F.aggregate(top["related"], own, lambda s, r: one(s, top["rank"], r["at"], r["id"], r["num_tokens"]))
        return F.when(_verdict(state, top["id"], top["num_tokens"], limit) == ADMITTED, with_related).otherwise(own)

    related = F.transform("related", lambda r: F.struct(r["at"].alias("at"), r["id"].alias("id"), r["num_tokens"].cast("long").alias("num_tokens")))
    lists = expanded.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "id", F.col("num_tokens").cast("long").alias("num_tokens"), related.alias("related")))).alias("tops"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("added"), F.array().cast(OUT).alias("out"))
    return lists.select("query_id", F.inline(F.aggregate("tops", start, step)["out"]))


def pack_flat(top: DataFrame, limit: int) -> DataFrame:
    """Without related chunks and repeats, what is admitted is what the running total allows, up to the first that finds no room."""
    total = F.sum("num_tokens").over(of_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return top.withColumn("total", total).withColumn("skip", F.col("total") > limit).withColumn("skip_reason", F.when(F.col("skip"), NO_ROOM).otherwise(ADMITTED))


def retrieve(queries: DataFrame, chunks: DataFrame, conf: EngineConf) -> tuple[DataFrame, DataFrame]:
    """The expanded top chunks of each query, and the verdicts on them and their related chunks."""
    expanded = expand(winners(top(queries, chunks, conf.top_n), chunks), chunks)
    return expanded, pack(expanded, conf.budget)


def sources(expanded: DataFrame, packed: DataFrame) -> DataFrame:
    """The answer to a query as rows (query_id, rank, content, score, title, relevantChunks, num_tokens, skip, position, skip_reason); a score that JSON can't hold is null."""
    of = packed.groupBy(F.col("query_id").alias("q"), F.col("rank").alias("r")).agg(F.max_by(F.struct("skip", "skip_reason"), -F.col("at")).alias("own"), F.map_from_entries(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", F.struct("skip", "skip_reason"))))).alias("of_related"))
    joined = expanded.join(of, (F.col("query_id") == F.col("q")) & (F.col("rank") == F.col("r")))
    verdict = lambda x: F.element_at("of_related", x["at"])
    chunk = F.transform("related", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["content"].alias("content"), x["num_tokens"].alias("num_tokens"), verdict(x)["skip"].alias("skip"), x["position"].alias("position"), verdict(x)["skip_reason"].alias("skip_reason")))
    none = F.slice(chunk, 1, 0)
    return joined.select("query_id", "rank", "content", numbers.json_number(F.col("score")).alias("score"), "title", F.when(F.col("own.skip"), none).otherwise(chunk).alias("relevantChunks"), "num_tokens", F.col("own.skip").alias("skip"), "position", F.col("own.skip_reason").alias("skip_reason"))


def token_totals(packed: DataFrame) -> DataFrame:
    """Tokens of all admitted chunks, and how many chunks there are and are admitted."""
    return packed.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("skip"), F.col("num_tokens"))), F.lit(0)).alias("tokens"), F.count("*").alias("n_sources"), F.count_if(~F.col("skip")).alias("n_used"))
