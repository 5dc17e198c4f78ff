"""Queries of retrieval, prompts and the graph. The chunk store is `embeddings` with the `documents` of the same id; queries are the vectors whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions import numbers, text, vector
from ..operators import graph, index, prompt, retrieve
from ..sources import shared

CONF = EngineConf()
TEMPLATES = {"0": "Context:\n{context_str}\n\nQuestion: {query_str}", "default": "{context_str}\n---\n{query_str} {{end}}"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as annotated chunks that refer to others, to themselves, twice, and to ids that there may not be."""
    docs = read(spark, sf_dir, "documents")
    id_ = F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("ErwG "), id_)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Art "), id_)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Anhang "), (F.col("doc_id") % 100).cast("string"))).otherwise("")
    related = F.array(*[x.cast("string") for x in (F.col("doc_id") + 10, F.col("doc_id") * 11 % 1000, F.col("doc_id") + 10, F.col("doc_id"))])
    return docs.select("doc_id", F.col("lang").alias("dataset_id"), F.col("doc_id").alias("ord"), F.lit("chunk").alias("kind"), id_.alias("id"), title.alias("title"), F.col("text").alias("content"), related.alias("relevantChunksIds"))


CHUNKS = """
chunks AS (
  SELECT doc_id, lang AS dataset_id, doc_id AS ord, CAST(doc_id AS VARCHAR) AS id, text AS content,
    CASE doc_id % 4 WHEN 0 THEN 'ErwG ' || doc_id WHEN 1 THEN 'Art ' || doc_id WHEN 2 THEN 'Anhang ' || (doc_id % 100) ELSE '' END AS title,
    [CAST(doc_id + 10 AS VARCHAR), CAST(doc_id * 11 % 1000 AS VARCHAR), CAST(doc_id + 10 AS VARCHAR), CAST(doc_id AS VARCHAR)] AS related
  FROM documents
)"""


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store is written once, as a service keeps it, and each use reads the columns that it needs."""
    own = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    return shared.written(index.build(chunks(spark, sf_dir).join(own, "doc_id").withColumn("dataset_id", F.col("label")).drop("label", "doc_id")))


STORE = (
    CHUNKS
    + """,
raw_store AS (
  SELECT CAST(label AS VARCHAR) AS dataset_id, id, title, content, related, CAST(ceil(length(content) / 4.0) AS INTEGER) AS num_tokens,
    CAST(embedding AS DOUBLE[]) AS vector, CAST(row_number() OVER (PARTITION BY label ORDER BY ord) - 1 AS INTEGER) AS position
  FROM embeddings JOIN chunks ON vec_id = doc_id WHERE trim(content) <> ''
), ids AS (SELECT dataset_id, list(DISTINCT id) AS known FROM raw_store GROUP BY 1),
store AS (SELECT r.* EXCLUDE (related), list_filter(related, lambda x: list_contains(known, x)) AS related FROM raw_store r JOIN ids USING (dataset_id))"""
)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("dataset_id"), F.col("embedding").alias("query_vector"))


def best(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The top chunks of each query by scores of six places, and the store."""
    own = store(spark, sf_dir)
    return retrieve.top(asked(spark, sf_dir), own, CONF.top_n, places=6), own


SCORED = (
    STORE
    + """,
scored AS (
  SELECT e.vec_id AS query_id, s.*, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), s.vector), 6) AS score
  FROM embeddings e JOIN store s ON CAST(e.label AS VARCHAR) = s.dataset_id WHERE e.vec_id % 20 = 0
), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position DESC) AS INTEGER) AS rank FROM scored QUALIFY rank <= 15)"""
)


def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six places, so that equal ones are equal in any engine."""
    return retrieve.scores(asked(spark, sf_dir), store(spark, sf_dir)).withColumn("score", F.round("score", 6))


def topk_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, own = best(spark, sf_dir)
    return retrieve.winners(found, own.select("dataset_id", "position", "id")).select("query_id", "rank", "id", "score")


def retrieve_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, own = best(spark, sf_dir)
    return retrieve.pack_flat(retrieve.winners(found, own.select("dataset_id", "position", "id", "num_tokens")), CONF.budget).select("query_id", "rank", "id", "num_tokens", "total", "skip", "skip_reason")


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, own = best(spark, sf_dir)
    own = own.drop("vector", "norm")
    return retrieve.expand(retrieve.winners(found, own), own)


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.pack(expanded(spark, sf_dir), CONF.budget)


RELATED = (
    SCORED
    + """,
rel AS (
  SELECT t.query_id, t.rank, t.dataset_id, u.place - 1 AS place, t.related[u.place] AS rid FROM top t, (SELECT unnest(range(1, 5)) AS place) u WHERE u.place <= len(t.related)
), relm AS (
  SELECT r.query_id, r.rank, CAST(r.place AS INTEGER) AS place, r.rid AS id, CASE WHEN coalesce(s.title, '') = '' THEN r.rid ELSE s.title END AS title, coalesce(s.content, '') AS content,
    coalesce(s.num_tokens, 0) AS num_tokens, coalesce(s.position, -1) AS position
  FROM rel r LEFT JOIN store s ON s.dataset_id = r.dataset_id AND s.id = r.rid
)"""
)
PACKED = (
    RELATED
    + """,
cand AS (
  SELECT query_id, rank, place, id, num_tokens, title, content, position, row_number() OVER (PARTITION BY query_id ORDER BY rank, place) AS n
  FROM (SELECT query_id, rank, -1 AS place, id, num_tokens, title, content, position FROM top UNION ALL SELECT query_id, rank, place, id, num_tokens, title, content, position FROM relm)
), fold AS (
  SELECT query_id, 0::BIGINT AS n, 0 AS rank, -1 AS place, '' AS id, 0::BIGINT AS num_tokens, 0::BIGINT AS total, false AS isfull, false AS open, CAST([] AS VARCHAR[]) AS added, CAST(NULL AS VARCHAR) AS reason
  FROM (SELECT DISTINCT query_id FROM cand)
  UNION ALL
  SELECT query_id, n, rank, place, id, num_tokens, CASE WHEN reason = '' THEN total + num_tokens ELSE total END, isfull OR coalesce(reason = 'context_window', false),
    CASE WHEN place = -1 THEN reason = '' ELSE open END, CASE WHEN reason = '' THEN list_append(added, id) ELSE added END, reason
  FROM (
    SELECT c.query_id, c.n, c.rank, c.place, c.id, CAST(c.num_tokens AS BIGINT) AS num_tokens, f.total, f.isfull, f.open, f.added,
      CASE WHEN c.place >= 0 AND NOT f.open THEN NULL WHEN f.isfull THEN 'context_window' WHEN list_contains(f.added, c.id) THEN 'duplicate' WHEN f.total + c.num_tokens <= 6500 THEN '' ELSE 'context_window' END AS reason
    FROM fold f JOIN cand c ON c.query_id = f.query_id AND c.n = f.n + 1
  )
), packed AS (SELECT query_id, rank, place, id, num_tokens, reason <> '' AS skip, reason AS skip_reason FROM fold WHERE reason IS NOT NULL)"""
)


def retrieve_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).withColumnRenamed("at", "place")


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.token_totals(packed(spark, sf_dir)).select("query_id", "tokens", numbers.german_integer(F.col("tokens")).alias("shown"))


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.token_totals(packed(spark, sf_dir)).select("query_id", "n_sources", "n_used")


def related_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(spark, sf_dir).select("query_id", "rank", F.inline("related")).select("query_id", "rank", F.col("at").alias("place"), "id", "title", F.length("content").alias("n_chars"), "num_tokens", "position")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = expanded(spark, sf_dir)
    rows = retrieve.sources(both, retrieve.pack(both, CONF.budget))
    return rows.select("query_id", "rank", "score", "title", "num_tokens", "skip", "position", "skip_reason", F.size("relevantChunks").alias("n_related"), F.coalesce(F.aggregate("relevantChunks", F.lit(0).cast("long"), lambda s, x: s + F.when(~x["skip"], x["num_tokens"]).otherwise(0)), F.lit(0)).alias("related_tokens"))


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = expanded(spark, sf_dir)
    own = both.select("query_id", "rank", F.lit(-1).alias("at"), "title", "content", "position").unionByName(both.select("query_id", "rank", F.inline("related")).select("query_id", "rank", "at", "title", "content", "position"))
    return own.join(retrieve.pack(both, CONF.budget).where(~F.col("skip")).select("query_id", "rank", "at"), ["query_id", "rank", "at"])


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt.context(admitted(spark, sf_dir), order_from_source=True)


def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked_ = asked(spark, sf_dir).select("query_id", "dataset_id", F.concat(F.lit("What of {context_str} "), F.col("query_id").cast("string"), F.lit("?")).alias("prompt"))
    filled = prompt.render(asked_.join(prompt.context(admitted(spark, sf_dir)), "query_id", "left"), TEMPLATES, "default")
    return filled.select("query_id", text.rule_before_titles(F.col("rendered")).alias("rendered"))


def list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.datasets(store(spark, sf_dir))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = index.build(chunks(spark, sf_dir).withColumn("vector", F.array(F.lit(1.0))))
    return built.select("dataset_id", "id", "title", F.array_join("relevantChunksIds", ",").alias("related"), "position", "num_tokens")


def valid_related_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.valid_related(chunks(spark, sf_dir)).select("id", F.size("relevantChunksIds").alias("n_valid"))


def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.batches(chunks(spark, sf_dir), CONF.batch).groupBy("dataset_id", "batch").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def embed_text_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("id", F.sha2(text.embedding_text(F.col("content"), "passage", CONF.embedding_model), 256).alias("passage"), F.sha2(text.embedding_text(F.col("content"), "query", "other"), 256).alias("query"))


def to_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "documents").select(F.col("lang").alias("dataset_id")).unionByName(read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("dataset_id"))).distinct()
    return index.to_create(wanted, store(spark, sf_dir))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


def content_length_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.enrich(chunks(spark, sf_dir)).select("id", "content_length", "content_plus_length", "relevantChunksIdsNum")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_by_title(chunks(spark, sf_dir))


def graph_nodes_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_by_id(chunks(spark, sf_dir))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_by_id(chunks(spark, sf_dir))


def graph_edges_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_by_title(chunks(spark, sf_dir))


def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.size_metrics(graph.enrich(chunks(spark, sf_dir)))


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.edges_by_id(chunks(spark, sf_dir)))


def incoming_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incoming(chunks(spark, sf_dir))


def last_wins_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("title").agg(F.max_by("id", "ord").alias("id"), F.min_by("id", "ord").alias("first_id"))



COLOR = "CASE WHEN starts_with({0}, 'ErwG') THEN 'violet' WHEN starts_with({0}, 'Art') THEN 'SpringGreen' WHEN starts_with({0}, 'Anhang') THEN 'SkyBlue' ELSE 'gray' END"
EDGES = ", edges AS (SELECT DISTINCT c.id AS src, r.rid AS dst FROM (SELECT id, unnest(related) AS rid FROM chunks) r JOIN chunks c ON c.id = r.id JOIN chunks k ON k.id = r.rid)"
ENRICHED = """, len AS (SELECT id AS rid, length(content) AS n FROM chunks), enriched AS (
  SELECT c.id, length(c.content) AS content_length, length(c.content) + coalesce(sum(len.n), 0) AS content_plus_length, 4 AS num
  FROM (SELECT id, content, unnest(related) AS rid FROM chunks) c LEFT JOIN len USING (rid) GROUP BY c.id, c.content)"""
ADMITTED = """, adm AS (SELECT c.* FROM cand c JOIN packed p ON c.query_id = p.query_id AND c.rank = p.rank AND c.place = p.place WHERE NOT p.skip)"""
PIECE = "'Titel: ' || title || ' ' || chr(10) || content || chr(10) || chr(10)"

QUERIES = {
    f.__name__: f
    for f in (cosine_scores, topk_chunks, retrieve_flat, retrieve_packed, token_totals, source_counts, related_lookup, sources, prompt_context, render_prompt, list_datasets, index_build, valid_related_semi, embedding_batches, embed_text_prefix, to_create, vector_norms, content_length_enrich, graph_nodes, graph_nodes_by_id, graph_edges, graph_edges_by_title, graph_sizes, graph_degree, incoming_refs, last_wins_map)
}
SQL = {
    "cosine_scores": f"WITH {SCORED} SELECT query_id, id, score FROM scored",
    "topk_chunks": f"WITH {SCORED} SELECT query_id, rank, id, score FROM top",
    "retrieve_flat": f"WITH {SCORED} SELECT query_id, rank, id, num_tokens, total, total > 6500 AS skip, CASE WHEN total > 6500 THEN 'context_window' ELSE '' END AS skip_reason FROM (SELECT *, CAST(sum(num_tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS total FROM top)",
    "retrieve_packed": f"WITH RECURSIVE {PACKED} SELECT query_id, rank, place, id, num_tokens, skip, skip_reason FROM packed",
    "token_totals": f"WITH RECURSIVE {PACKED} SELECT query_id, CAST(coalesce(sum(num_tokens) FILTER (NOT skip), 0) AS BIGINT) AS tokens, replace(format('{{:,}}', CAST(coalesce(sum(num_tokens) FILTER (NOT skip), 0) AS BIGINT)), ',', '.') AS shown FROM packed GROUP BY 1",
    "source_counts": f"WITH RECURSIVE {PACKED} SELECT query_id, count(*) AS n_sources, count(*) FILTER (NOT skip) AS n_used FROM packed GROUP BY 1",
    "related_lookup": f"WITH {RELATED} SELECT query_id, rank, place, id, title, CAST(length(content) AS INTEGER) AS n_chars, num_tokens, position FROM relm",
    "sources": f"WITH RECURSIVE {PACKED} SELECT t.query_id, t.rank, t.score, t.title, t.num_tokens, p.skip, t.position, p.skip_reason, CAST(count(q.place) AS INTEGER) AS n_related, CAST(coalesce(sum(q.num_tokens) FILTER (NOT q.skip), 0) AS BIGINT) AS related_tokens FROM top t JOIN packed p ON p.query_id = t.query_id AND p.rank = t.rank AND p.place = -1 LEFT JOIN packed q ON q.query_id = t.query_id AND q.rank = t.rank AND q.place >= 0 GROUP BY ALL",
    "prompt_context": f"WITH RECURSIVE {PACKED}{ADMITTED} SELECT query_id, trim(string_agg({PIECE}, '' ORDER BY position, rank, place), ' ' || chr(10)) AS context FROM adm GROUP BY 1",
    "render_prompt": f"""WITH RECURSIVE {PACKED}{ADMITTED}, con AS (SELECT query_id, trim(string_agg({PIECE}, '' ORDER BY rank, place), ' ' || chr(10)) AS context FROM adm GROUP BY 1),
      q AS (SELECT vec_id AS query_id, CAST(label AS VARCHAR) AS dataset_id, 'What of {{context_str}} ' || vec_id || '?' AS prompt, coalesce(context, '') AS context FROM embeddings LEFT JOIN con ON query_id = vec_id WHERE vec_id % 20 = 0),
      r AS (SELECT query_id, CASE WHEN dataset_id = '0' THEN 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || prompt ELSE context || chr(10) || '---' || chr(10) || prompt || ' {{end}}' END AS p FROM q)
      SELECT query_id, array_to_string(list_transform(string_split(p, chr(10)), lambda l: CASE WHEN starts_with(ltrim(l), 'Titel:') THEN '<hr>' || l ELSE l END), chr(10)) AS rendered FROM r""",
    "list_datasets": f"WITH {STORE} SELECT DISTINCT dataset_id FROM store",
    "index_build": f"WITH {CHUNKS}, kept AS (SELECT * FROM chunks WHERE trim(content) <> ''), ids AS (SELECT dataset_id, list(id) AS known FROM kept GROUP BY 1) SELECT dataset_id, id, title, array_to_string(list_filter(related, lambda x: list_contains(known, x)), ',') AS related, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY ord) - 1 AS INTEGER) AS position, CAST(ceil(length(content) / 4.0) AS INTEGER) AS num_tokens FROM kept JOIN ids USING (dataset_id)",
    "valid_related_semi": f"WITH {CHUNKS}, ids AS (SELECT dataset_id, list(id) AS known FROM chunks GROUP BY 1) SELECT id, CAST(len(list_filter(related, lambda x: list_contains(known, x))) AS INTEGER) AS n_valid FROM chunks JOIN ids USING (dataset_id)",
    "embedding_batches": f"WITH {CHUNKS} SELECT dataset_id, CAST(floor(rn / 10) AS BIGINT) AS batch, count(*) AS n, min(ord) AS first_ord FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ord) - 1 AS rn FROM chunks) GROUP BY 1, 2",
    "embed_text_prefix": f"WITH {CHUNKS} SELECT id, sha256('passage: ' || content) AS passage, sha256(content) AS query FROM chunks",
    "to_create": f"WITH {STORE} SELECT DISTINCT dataset_id FROM (SELECT lang AS dataset_id FROM documents UNION ALL SELECT CAST(label AS VARCHAR) FROM embeddings) w WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.dataset_id = w.dataset_id)",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings",
    "content_length_enrich": f"WITH {CHUNKS}{ENRICHED} SELECT id, CAST(content_length AS INTEGER) AS content_length, CAST(content_plus_length AS BIGINT) AS content_plus_length, num AS relevantChunksIdsNum FROM enriched",
    "graph_nodes": f"WITH {CHUNKS} SELECT title, CAST(arg_min(length(content), ord) AS INTEGER) AS content_length, {COLOR.format('title')} AS color, 10.0::DOUBLE + arg_min(length(content), ord) / 100.0::DOUBLE AS size FROM chunks GROUP BY title",
    "graph_nodes_by_id": f"WITH {CHUNKS} SELECT id, arg_max(title, ord) AS title, {COLOR.format('arg_max(title, ord)')} AS color FROM chunks GROUP BY id",
    "graph_edges": f"WITH {CHUNKS}{EDGES} SELECT src, dst, 'black' AS color FROM edges",
    "graph_edges_by_title": f"WITH {CHUNKS}, e AS (SELECT DISTINCT c.title AS src_title, k.title AS dst_title FROM (SELECT title, unnest(related) AS rid FROM chunks) c JOIN chunks k ON k.id = c.rid WHERE k.title <> '') SELECT src_title, dst_title, {COLOR.format('src_title')} AS color FROM e",
    "graph_sizes": f"WITH {CHUNKS}{ENRICHED} SELECT id, 'content_length' AS measure, 10.0::DOUBLE + content_length / 100.0::DOUBLE AS size FROM enriched UNION ALL SELECT id, 'content_plus_length', 10.0::DOUBLE + content_plus_length / 500.0::DOUBLE FROM enriched UNION ALL SELECT id, 'relevantChunksIdsNum', 10.0::DOUBLE + num / 0.5::DOUBLE FROM enriched",
    "graph_degree": f"WITH {CHUNKS}{EDGES}, b AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM b GROUP BY 1",
    "incoming_refs": f"WITH {CHUNKS} SELECT c.id, count(DISTINCT r.id) AS n_incoming FROM chunks c LEFT JOIN (SELECT id, unnest(related) AS rid FROM chunks) r ON r.rid = c.id GROUP BY 1",
    "last_wins_map": f"WITH {CHUNKS} SELECT title, arg_max(id, ord) AS id, arg_min(id, ord) AS first_id FROM chunks GROUP BY 1",
}
