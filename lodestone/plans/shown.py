"""Queries of what is shown and handed out: sources as JSON holds them, hover texts, links, labels, selections; a store by a model that the caller brings; alignment with attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import align, annotate, events, graph, index, retrieve
from ..sources import readers, shared, writers
from .corpus import ALIGNED, ITEMS, RESPONSE, aligned, docs, items, known, parts, requests
from .retrieval import CHUNKS, CONF, SCORED, asked, chunks, read, store

DATASETS = {"de": "act-de", "en": "act-en"}


def toy_model():  # noqa: ANN201
    """A model that is easily worked out: code points, blanks, and one."""
    return lambda texts: ([[float(len(t)), float(t.count(" ")), 1.0] for t in texts], 0.0)


def embedded_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store whose vectors a model makes, ten texts a call, and whose tokens a counter of the caller's counts."""
    built = index.build_with(chunks(spark, sf_dir), toy_model, CONF.embedding_model, CONF.batch, lambda c: F.size(F.split(c, " ")))
    return built.select("dataset_id", "id", "position", "num_tokens", F.element_at("vector", 1).alias("n_chars"), F.element_at("vector", 2).alias("n_blanks"), F.round("norm", 6).alias("norm"))


def sources_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth chunk has a vector without length: its score is NaN, which comes first and which JSON has as null."""
    own = shared.written(store(spark, sf_dir).withColumn("vector", F.when(F.col("position") % 10 == 0, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector"))))
    found = retrieve.top(asked(spark, sf_dir), own, CONF.top_n, places=6)
    own = own.drop("vector", "norm")
    both = retrieve.expand(retrieve.winners(found, own), own)
    rows = retrieve.sources(both, retrieve.pack(both, CONF.budget))
    out = F.from_json(F.to_json(F.struct("score", "position")), "score string, position int")
    return rows.select("query_id", "rank", text.or_else(F.col("title"), F.lit("Source")).alias("title"), out["position"].alias("position"), out["score"].isNull().alias("none"))


def align_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated chunks with the attributes of the original ones; some of these have no title or lists."""
    reference = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("chunk_idx"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("array<string>").alias("keywords"))
    own = docs(spark, sf_dir).select((F.col("doc_id") + 1_000_000).cast("int").alias("chunk_idx"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.array("lang", "source").alias("keywords"))
    whole = align.consolidate(aligned(spark, sf_dir), reference.unionByName(own))
    lists = [F.array_join(c, ",").alias(c) for c in ("keywords", "relevantChunksIds", "negativeKeywords")]
    return whole.select("chunk_idx", "id", "title", *lists, F.sha2("content", 256).alias("content_sha"))


def graph_stored_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chunk comes with a length from before, which counts where others refer to it, and nowhere else."""
    stored = chunks(spark, sf_dir).withColumn("content_length", F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") * 7).cast("int")))
    return graph.enrich(stored).select("id", "content_length", "content_plus_length")


def hover_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("id", F.sha2(text.hover(F.col("title"), F.length("content"), F.col("content")), 256).alias("sha"))


def mail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link a message, its role as subject."""
    link = text.mail_link("help@example.org", F.col("role"), F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(link, 256).alias("sha"), F.length(link).alias("n"))


def locale_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", numbers.dataset_of(F.col("lang"), DATASETS).alias("dataset_id"))


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.response_events(requests(spark, sf_dir), parts(spark, sf_dir), known(spark, sf_dir))
    return rows.select("request_id", "seq", numbers.power_label(F.col("type")).alias("label"), numbers.next_step(F.col("type"), F.lit("as it was")).alias("step"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections in every item, some of them empty, reversed or of nothing."""
    start, end, id_ = F.col("ord") - 1, F.length("content") % 4, F.when(F.col("doc") % 5 == 0, "").otherwise(F.col("id"))
    return items(spark, sf_dir).groupBy("doc", annotate.selection_valid(start, end, id_).alias("valid")).agg(F.count("*").alias("n"))


def base64_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to Base64 and back."""
    back = readers.decoded(writers.encoded(docs(spark, sf_dir).select("doc_id", "text"), "text"), "text")
    return back.select("doc_id", F.sha2("text", 256).alias("sha"))


def dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of chunks that share a title, the last one's id; and the first one whole."""
    own = chunks(spark, sf_dir).select("title", "id", "ord")
    last = readers.last_of_key(own, "title", "id", "ord").select("title", "id", F.lit("last").alias("which"))
    return last.unionByName(readers.first_of_key(own, "title", "ord").select("title", "id", F.lit("first").alias("which")))


def energy_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.round(numbers.energy_from_micro(F.col("value")), 12).alias("from_micro"), F.round(numbers.energy_from_milli(F.col("value")), 12).alias("from_milli"))


_COSINE = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), s.vector), 6)"
_ENCODED = "replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')')"
_LINK = f"'mailto:help@example.org?subject=' || {_ENCODED.format('role')} || '&body=' || {_ENCODED.format('text')}"

QUERIES = {f.__name__: f for f in (embedded_store, sources_json, align_attributes, graph_stored_lengths, hover_texts, mail_links, locale_datasets, event_labels, selections, base64_texts, dictionaries, energy_units)}
SQL = {
    "embedded_store": f"""WITH {CHUNKS}, kept AS (SELECT *, 'passage: ' || content AS sent FROM chunks WHERE trim(content) <> ''), v AS (SELECT *, CAST(length(sent) AS DOUBLE) AS n_chars, CAST(length(sent) - length(replace(sent, ' ', '')) AS DOUBLE) AS n_blanks FROM kept)
      SELECT dataset_id, id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY ord) - 1 AS INTEGER) AS position, CAST(len(string_split(content, ' ')) AS INTEGER) AS num_tokens, n_chars, n_blanks, round(sqrt(n_chars * n_chars + n_blanks * n_blanks + 1), 6) AS norm FROM v""",
    "sources_json": f"WITH {SCORED.replace(_COSINE, f'CASE WHEN s.position % 10 = 0 THEN CAST({chr(39)}NaN{chr(39)} AS DOUBLE) ELSE {_COSINE} END')} SELECT query_id, rank, CASE WHEN title = '' THEN 'Source' ELSE title END AS title, position, isnan(score) AS none FROM top",
    "align_attributes": f"""WITH RECURSIVE {ALIGNED}, whole AS (SELECT chunk_idx, sha256(string_agg(content, chr(10) ORDER BY place)) AS content_sha FROM entries GROUP BY 1),
      attributes AS (SELECT CAST(item_id AS INTEGER) AS chunk_idx, 'b' || item_id AS id, 'N/A' AS title, '' AS keywords FROM benchmark UNION ALL SELECT CAST(doc_id + 1000000 AS INTEGER), CAST(doc_id AS VARCHAR), coalesce(source, 'N/A'), concat_ws(',', lang, source) FROM documents)
      SELECT chunk_idx, id, title, keywords, '' AS "relevantChunksIds", '' AS "negativeKeywords", content_sha FROM whole JOIN attributes USING (chunk_idx)""",
    "graph_stored_lengths": f"""WITH {CHUNKS}, len AS (SELECT id AS rid, CASE WHEN doc_id % 3 = 0 THEN doc_id * 7 ELSE length(content) END AS n FROM chunks)
      SELECT c.id, CAST(length(c.content) AS INTEGER) AS content_length, CAST(length(c.content) + coalesce(sum(len.n), 0) AS BIGINT) AS content_plus_length FROM (SELECT id, content, unnest(related) AS rid FROM chunks) c LEFT JOIN len USING (rid) GROUP BY c.id, c.content""",
    "hover_texts": f"WITH {CHUNKS} SELECT id, sha256('Title: ' || title || ' | Content Length: ' || length(content) || ' | ' || left(content, 3000) || '...') AS sha FROM chunks",
    "mail_links": f"SELECT conv_id, turn, sha256({_LINK}) AS sha, CAST(length({_LINK}) AS INTEGER) AS n FROM conversations",
    "locale_datasets": "SELECT doc_id, CASE WHEN lang = 'en' THEN 'act-en' ELSE 'act-de' END AS dataset_id FROM documents",
    "event_labels": f"""WITH {RESPONSE} SELECT request_id, seq, CASE type WHEN 'power_index' THEN 'Indexierung von relevanten Daten (einmalig pro Serverstart)' WHEN 'power_prompt' THEN 'Erstellung des Prompts („Retrieve" und „Augment")' WHEN 'power_response' THEN 'Generierung der Antwort („Generate")' ELSE '' END AS label,
      CASE type WHEN 'sources' THEN 'prompt' WHEN 'user' THEN 'output' ELSE 'as it was' END AS step FROM response""",
    "selections": f"WITH {ITEMS}, s AS (SELECT doc, ord - 1 AS a, length(content) % 4 AS b FROM items) SELECT doc, a <> b AND b > 0 AND a >= 0 AND doc % 5 <> 0 AS valid, count(*) AS n FROM s GROUP BY 1, 2",
    "base64_texts": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "dictionaries": f"WITH {CHUNKS} SELECT title, arg_max(id, ord) AS id, 'last' AS which FROM chunks GROUP BY 1 UNION ALL SELECT title, arg_min(id, ord), 'first' FROM chunks GROUP BY 1",
    "energy_units": "SELECT event_id, round(value / 1e6, 12) AS from_micro, round(value / 1e3, 12) AS from_milli FROM events",
}
