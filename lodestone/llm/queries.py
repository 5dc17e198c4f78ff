"""The queries of these operators over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, jaccard_join, language_id, license_scan, lm_scoring, packing, prefix_trie, sentencepiece_codec, spelling, suffix_dedup, token_counts, topk_search
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def crc_of_id(modulus: int) -> Column:
    """Null for a null id, which is neither learnt from nor held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.vector, b.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language_id.fit(docs.where(crc_of_id(4) != 2).select("text", "lang"))
    return language_id.predict(docs, filters).select("doc_id", F.coalesce(crc_of_id(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits for each document: a twentieth of it from its end put in place of as much at a third, then as much taken out at two thirds."""
    n = F.length("text").cast("long")
    part = F.floor(n / 20)
    end = F.expr("right(text, cast(floor(length(text) / 20) as int))")
    edit = lambda at, upto, new: F.struct(at.alias("start"), upto.alias("end"), new.alias("text"))
    edits = F.array(edit(F.floor(n / 3), F.floor(n / 3) + part, end), edit(F.floor(2 * n / 3), F.floor(2 * n / 3) + part, F.lit("")))
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return token_counts.count(docs.select("doc_id", "text", edits.alias("edits")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_scoring.score(docs, crc_of_id(5) != 1)
    return scored.select("doc_id", F.coalesce(crc_of_id(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    return spelling.variants(spelling.counted(runs.select(spelling.misspelt(runs).alias("word"))))


#: The crc32 of a list of bytes, as a sum of shifts and exclusive ors.
CRC = "xor(list_reduce({0}, lambda crc, b: list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
LATIN_BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))"
OP11_SQL = f"""
WITH RECURSIVE run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents
), each AS (SELECT doc_id, w, count(*) AS n FROM run GROUP BY 1, 2),
hashed AS (SELECT w, n, {CRC.format(LATIN_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w"))} AS h FROM each),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
less AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS rest FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM v)),
near AS (
  SELECT a.w, b.w AS u FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.w <> b.w
  UNION SELECT a.w, b.w FROM less a JOIN v b ON a.rest = b.w
  UNION SELECT b.w, a.w FROM less a JOIN v b ON a.rest = b.w
), best AS (
  SELECT near.w, u, v.n AS un, count(*) OVER (PARTITION BY near.w) AS n_near, row_number() OVER (PARTITION BY near.w ORDER BY v.n DESC, u) AS place FROM near JOIN v ON v.w = near.u
), formed AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN un >= 2 * v.n THEN u END AS form, CASE WHEN un >= 2 * v.n THEN un END AS form_n FROM v LEFT JOIN best ON best.w = v.w AND place = 1),
walk AS (SELECT w, w AS root, 0 AS step FROM v UNION ALL SELECT walk.w, f.form, step + 1 FROM walk JOIN formed f ON f.w = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT w, arg_max(root, step) AS root FROM walk GROUP BY 1)
SELECT f.w AS word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed f JOIN ends USING (w)
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), e AS (SELECT conv_id, conv_id - conv_id % 5 AS first_id, {CRC.format("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT e.conv_id, place, role, text FROM e JOIN t ON t.conv_id = e.first_id AND place <= h
  UNION ALL SELECT t.conv_id, place, role, text FROM t JOIN e ON e.conv_id = t.conv_id WHERE place > h
), p AS (
  SELECT conv_id, text, row_number() OVER w AS depth, string_agg(sha256(role || chr(1) || text), '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
), every AS (SELECT conv_id, depth, path, text FROM p UNION ALL SELECT conv_id, 0, '', '' FROM e),
ends AS (SELECT conv_id, max(depth) AS depth, arg_max(path, depth) AS path FROM every GROUP BY 1),
ended AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM ends GROUP BY 1),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(any_value(text)) END AS own FROM every GROUP BY 1, 2),
child AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
below AS (SELECT a.path, sum(b.own) AS saved, count(*) FILTER (c.n IS NULL) AS leaves FROM node a JOIN node b ON starts_with(b.path, a.path) LEFT JOIN child c ON c.path = b.path GROUP BY 1)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM node JOIN below ON below.path = node.path LEFT JOIN child ON child.path = node.path LEFT JOIN ended ON ended.path = node.path
LEFT JOIN node up ON up.depth = node.depth - 1 AND up.path = left(node.path, length(node.path) - 64)
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


QUERIES: dict[str, Query] = {
    "op1_topk_search": op1_topk_search,
    "op2_license_scan": op2_license_scan,
    "op3_fingerprints": op3_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_packing": op10_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_dedup": op13_exact_dedup,
}
SQL: dict[str, str] = {"op1_topk_search": OP1_SQL, "op11_spelling_variants": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_exact_dedup": OP13_SQL}
