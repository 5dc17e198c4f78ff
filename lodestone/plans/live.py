"""Queries of what happens over time: logs of edits, output in windows, steps and totals of responses. `conversations` stands for documents and requests, `events` for parts of output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sql
from ..operators import events, replay, response
from .corpus import ITEMS, RESPONSE, items, known, parts, requests
from .retrieval import read


def made(seq: int, part: int) -> Column:
    """The id of an item that an action of the log makes, as replay.new_id."""
    return F.left(F.sha2(F.concat(F.col("doc").cast("string"), F.lit(f"/{seq}/{part}")), 256), F.lit(32))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten actions on each conversation, most of them on what earlier ones made."""
    doc = F.col("doc")
    turn = lambda n: F.concat(doc.cast("string"), F.lit(f"/{n}"))
    whole = F.array(F.struct(F.lit("whole").alias("id"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("Set "), doc.cast("string")).alias("content"), *[F.lit(None).cast("array<string>").alias(c) for c in replay.LISTS]))

    def act(seq: int, action: str | Column, id_: Column, start: int | None = None, end: int | None = None, name: str | None = None, value: str | None = None, values: list[str] | None = None) -> Column:
        given = {"seq": F.lit(seq), "action": F.lit(action) if isinstance(action, str) else action, "id": id_, "start": F.lit(start), "end": F.lit(end), "property": F.lit(name), "value": F.lit(value), "values": F.array(*map(F.lit, values)) if values is not None else F.lit(None)}
        return F.struct(*[v.cast({"seq": "long", **replay.ACTION}[k]).alias(k) for k, v in given.items()], F.when(F.lit(seq == 10), whole).cast(replay.ACTION["items"]).alias("items"))

    log = [
        act(1, "create", turn(1), 5, 40),
        act(2, "update", made(1, 1), name="title", value="New"),
        act(3, "create", made(1, 2), -30, -4),
        act(4, "delete", turn(0)),
        act(5, "update", turn(2), name="content", value=" \n "),
        act(6, "delete", made(3, 1)),
        act(7, "update", made(1, 1), name="keywords", values=["a", "b"]),
        act(8, "create", turn(2), 2, 9),
        act(9, "delete", F.when(doc % 2 == 0, "").otherwise("unknown")),
        act(10, F.when(doc % 7 == 0, "set").otherwise("select"), turn(1), 0, 3),
    ]
    return items(spark, sf_dir).select("doc").distinct().select("doc", F.inline(F.array(*log)))


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = replay.replay(replay.complete(items(spark, sf_dir)), edits(spark, sf_dir))
    return after.select("doc", "ord", "kind", "id", "title", F.array_join("keywords", ",").alias("keywords"), F.sha2("content", 256).alias("sha"))


#: The log again, and a fold over it: the state is the list of items, a step takes the action of the next number.
_TRIM = "trim({0}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160))"
_AT = "CASE WHEN {0} < 0 THEN greatest(length({1}) + {0}, 0) ELSE {0} END"
_TEXT = "{{'id': {0}, 'title': NULL::VARCHAR, 'content': {1}, 'kw': NULL::VARCHAR}}"
_SLICED = f"""CASE WHEN list_filter(items, lambda x: x.id = l.id)[1].title IS NULL AND l.id <> '' AND l.a < l.b AND len(list_filter(items, lambda x: x.id = l.id)) > 0
  THEN flatten(list_transform(items, lambda x: CASE WHEN x.id = l.id THEN list_filter([
      {_TEXT.format("l.m0", _TRIM.format(f"left(x.content, {_AT.format('l.a', 'x.content')})"))},
      {{'id': l.m1, 'title': '', 'content': {_TRIM.format(f"substr(x.content, {_AT.format('l.a', 'x.content')} + 1, greatest({_AT.format('l.b', 'x.content')} - {_AT.format('l.a', 'x.content')}, 0))")}, 'kw': ''}},
      {_TEXT.format("l.m2", _TRIM.format(f"substr(x.content, {_AT.format('l.b', 'x.content')} + 1)"))}], lambda y: y.title IS NOT NULL OR y.content <> '')
    ELSE [x] END)) ELSE items END"""
_MERGED = _TEXT.format("CASE WHEN acc.items[-1].title IS NULL AND len(acc.items) > 0 THEN acc.items[-1].id ELSE l.m0 END", "CASE WHEN acc.items[-1].title IS NULL AND len(acc.items) > 0 THEN acc.items[-1].content ELSE '' END || x.items[1].content || CASE WHEN x.items[2].title IS NULL AND x.items[2].id IS NOT NULL THEN x.items[2].content ELSE '' END")
_DELETED = f"""CASE WHEN l.id = '' THEN items ELSE list_filter(list_reduce(
    list_transform(range(1, len(items) + 1), lambda i: {{'items': [items[i], items[i + 1]], 'skip': false}}),
    lambda acc, x: CASE WHEN acc.skip THEN {{'items': acc.items, 'skip': false}}
      WHEN x.items[1].id = l.id THEN {{'items': list_append(CASE WHEN acc.items[-1].title IS NULL AND len(acc.items) > 0 THEN acc.items[:-2] ELSE acc.items END, {_MERGED}), 'skip': x.items[2].id IS NOT NULL AND x.items[2].title IS NULL}}
      ELSE {{'items': list_append(acc.items, x.items[1]), 'skip': false}} END,
    {{'items': items[1:0], 'skip': false}}).items, lambda x: {_TRIM.format("x.content")} <> '') END"""
ACTION_LOG = f"""{ITEMS}, docs AS (SELECT DISTINCT doc FROM items),
made AS (SELECT doc, s.seq, left(sha256(doc || '/' || s.seq || '/0'), 32) AS m0, left(sha256(doc || '/' || s.seq || '/1'), 32) AS m1, left(sha256(doc || '/' || s.seq || '/2'), 32) AS m2 FROM docs, (SELECT unnest(range(1, 11)) AS seq) s),
log AS (
  SELECT m.doc, m.seq, m.m0, m.m1, m.m2,
    CASE m.seq WHEN 1 THEN 'create' WHEN 2 THEN 'title' WHEN 3 THEN 'create' WHEN 4 THEN 'delete' WHEN 5 THEN 'content' WHEN 6 THEN 'delete' WHEN 7 THEN 'keywords' WHEN 8 THEN 'create' WHEN 9 THEN 'delete' WHEN 10 THEN CASE WHEN m.doc % 7 = 0 THEN 'set' END END AS action,
    CASE m.seq WHEN 1 THEN m.doc || '/1' WHEN 2 THEN f.m1 WHEN 3 THEN f.m2 WHEN 4 THEN m.doc || '/0' WHEN 5 THEN m.doc || '/2' WHEN 6 THEN t.m1 WHEN 7 THEN f.m1 WHEN 8 THEN m.doc || '/2' WHEN 9 THEN CASE WHEN m.doc % 2 = 0 THEN '' ELSE 'unknown' END ELSE '' END AS id,
    CASE m.seq WHEN 1 THEN 5 WHEN 3 THEN -30 WHEN 8 THEN 2 END AS a, CASE m.seq WHEN 1 THEN 40 WHEN 3 THEN -4 WHEN 8 THEN 9 END AS b
  FROM made m JOIN (SELECT doc, m1, m2 FROM made WHERE seq = 1) f ON f.doc = m.doc JOIN (SELECT doc, m1 FROM made WHERE seq = 3) t ON t.doc = m.doc
), fold AS (
  SELECT doc, 0 AS seq, list({{'id': id, 'title': CASE WHEN kind = 'chunk' THEN '' END, 'content': content, 'kw': CASE WHEN kind = 'chunk' THEN '' END}} ORDER BY ord) AS items FROM items GROUP BY 1
  UNION ALL
  SELECT f.doc, f.seq + 1, CASE l.action WHEN 'create' THEN {_SLICED} WHEN 'delete' THEN {_DELETED}
    WHEN 'title' THEN list_transform(items, lambda x: CASE WHEN x.id = l.id THEN {{'id': x.id, 'title': 'New', 'content': x.content, 'kw': x.kw}} ELSE x END)
    WHEN 'content' THEN list_transform(items, lambda x: CASE WHEN x.id = l.id THEN {{'id': x.id, 'title': x.title, 'content': ' ' || chr(10) || ' ', 'kw': x.kw}} ELSE x END)
    WHEN 'keywords' THEN list_transform(items, lambda x: CASE WHEN x.id = l.id THEN {{'id': x.id, 'title': x.title, 'content': x.content, 'kw': 'a,b'}} ELSE x END)
    WHEN 'set' THEN [{_TEXT.format("'whole'", "'Set ' || f.doc")}] ELSE items END
  FROM fold f JOIN log l ON l.doc = f.doc AND l.seq = f.seq + 1
), ended AS (SELECT doc, unnest(items) AS x, generate_subscripts(items, 1) - 1 AS ord FROM fold WHERE seq = 10)"""


def anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in windows of a day that their first event opens."""
    own = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("content"))
    return response.coalesced(own, "user_id", 86_400_000_000)


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response events, two seconds apart, with an opening, a close for most, and a failure for some; power events with energies, sources with tokens."""
    body = events.response_events(requests(spark, sf_dir), parts(spark, sf_dir), known(spark, sf_dir)).select("request_id", (F.col("seq") + 1).cast("long").alias("seq"), "type")
    last = body.groupBy("request_id").agg(F.max("seq").alias("last"))
    conv = F.split("request_id", "/")[0].cast("long")
    at = lambda seq, kind: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("type"))
    more = F.array(at(F.lit(0), "open"), F.when(conv % 5 != 0, at(F.col("last") - 1, "close")), F.when(conv % 3 == 0, at(F.lit(5), "failure")))
    around = last.select("request_id", F.inline(F.filter(more, lambda x: x.isNotNull())))
    kwh = F.when(F.startswith("type", F.lit("power_")), (F.col("seq") + 1) / 1000)
    every = body.unionByName(around).withColumn("n", F.col("seq") * 2 + F.col("type").isin("close", "failure").cast("long"))
    return every.select("request_id", F.timestamp_seconds(F.col("n")).alias("ts"), F.col("n").alias("seq"), "type", F.when(F.col("type") == "sources", F.col("seq") * 100).alias("tokens"), kwh.alias("cpu_kWh"), (kwh * 2).alias("gpu_kWh"), (kwh / 4).alias("ram_kWh"), (kwh * 3.25).alias("total_kWh"), (kwh * 0 + 10).alias("duration"))


def response_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = response.steps(timed_events(spark, sf_dir))
    return run.select("request_id", "seq", "type", "step", "available", "tokens_so_far", F.round("kWh_so_far", 9).alias("kWh_so_far"))


def response_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = response.totals(timed_events(spark, sf_dir))
    return total.select("request_id", "closed_at", "tokens", "n_power", *[F.round(c, 9).alias(c) for c in ("per_query_kWh", *response.ENERGY)])


def open_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as requests of ten keys that take as many minutes as their value says; a third of them never ends. After an hour and a half they are given up."""
    e = read(spark, sf_dir, "events").where("event_type = 'signup'").select((F.col("user_id") % 10).cast("string").alias("key"), F.col("event_id").cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    over = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 60_000_000))
    change = lambda ts, seq, n: F.struct(ts.alias("at"), seq.alias("seq"), F.lit(n).alias("change"))
    both = F.array(change(F.col("ts"), F.col("event_id") * 2, 1), F.when(F.col("event_id") % 3 != 0, change(over, F.col("event_id") * 2 + 1, -1)))
    changes = e.select("key", "request_id", F.inline(F.filter(both, lambda x: x.isNotNull()))).withColumnRenamed("at", "ts")
    counted = events.open_requests(changes, 5400)
    return counted.select("key", "request_id", F.unix_micros("ts").alias("micros"), "seq", "change", "abandoned", "active")


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark SQL alone: documents with blanks around, and the likeness of each vector to the next."""
    sql.register(spark)
    return spark.sql(f"""
      SELECT d.doc_id, lodestone_preview(lodestone_py_strip(concat(' \u00a0', text, '\n\u2003'))) AS preview, lodestone_is_blank(left(text, 1)) AS blank, lodestone_approx_tokens(text) AS tokens,
        lodestone_queue_seconds(d.doc_id % 7) AS seconds, round(lodestone_kwh(double(d.doc_id), 90D), 9) AS kwh, round(lodestone_cosine(cast(a.embedding AS ARRAY<DOUBLE>), cast(b.embedding AS ARRAY<DOUBLE>)), 6) AS likeness
      FROM parquet.`{sf_dir}/documents.parquet` d LEFT JOIN parquet.`{sf_dir}/embeddings.parquet` a ON a.vec_id = d.doc_id LEFT JOIN parquet.`{sf_dir}/embeddings.parquet` b ON b.vec_id = d.doc_id + 1""")


TIMED = f"""{RESPONSE}, body AS (SELECT request_id, CAST(seq + 1 AS BIGINT) AS seq, type FROM response),
tops AS (SELECT request_id, max(seq) AS top, CAST(string_split(request_id, '/')[1] AS BIGINT) AS conv FROM body GROUP BY 1),
every AS (
  SELECT request_id, seq * 2 AS n, seq, type FROM body UNION ALL SELECT request_id, 0, 0, 'open' FROM tops
  UNION ALL SELECT request_id, (top - 1) * 2 + 1, top - 1, 'close' FROM tops WHERE conv % 5 <> 0 UNION ALL SELECT request_id, 11, 5, 'failure' FROM tops WHERE conv % 3 = 0
), timed AS (SELECT request_id, n, type, CASE WHEN type = 'sources' THEN seq * 100 END AS tokens, CASE WHEN starts_with(type, 'power_') THEN (seq + 1) / 1000 END AS kwh FROM every)"""
_OWN = "starts_with(type, 'power_') AND type <> 'power_index'"

QUERIES = {f.__name__: f for f in (action_log, anchored_windows, response_steps, response_totals, open_requests, sql_functions)}
SQL = {
    "sql_functions": """SELECT doc_id, CASE WHEN length(t) > 150 THEN left(t, 150) || '...' ELSE t END AS preview, trim(left(t0, 1), ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank, CAST(ceil(length(t0) / 4.0) AS INTEGER) AS tokens,
        greatest(greatest(doc_id % 7, 1) - 1, 1) * 40 AS seconds, round(doc_id * 90 / 3600::DOUBLE / 1000::DOUBLE, 9) AS kwh, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS likeness
      FROM (SELECT doc_id, text AS t0, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents) LEFT JOIN embeddings a ON a.vec_id = doc_id LEFT JOIN embeddings b ON b.vec_id = doc_id + 1""",
    "open_requests": """WITH s AS (SELECT CAST(user_id % 10 AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS request_id, CAST(epoch_us(ts) AS BIGINT) AS t, event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(epoch_us(ts) AS BIGINT) + CAST(floor(value * 60000000) AS BIGINT) END AS over FROM events WHERE event_type = 'signup'),
      r AS (SELECT key, request_id, t AS micros, event_id * 2 AS seq, 1 AS change, false AS abandoned, 2 AS rank FROM s
        UNION ALL SELECT key, request_id, over, event_id * 2 + 1, -1, false, 1 FROM s WHERE over < t + 5400000000
        UNION ALL SELECT key, request_id, t + 5400000000, NULL, -1, true, 0 FROM s WHERE over IS NULL OR over >= t + 5400000000)
      SELECT key, request_id, micros, seq, change, abandoned, CAST(sum(change) OVER (PARTITION BY key ORDER BY micros, rank, seq, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM r""",
    "action_log": f"WITH RECURSIVE {ACTION_LOG} SELECT doc, CAST(ord AS INTEGER) AS ord, CASE WHEN x.title IS NULL THEN 'text' ELSE 'chunk' END AS kind, x.id AS id, x.title AS title, x.kw AS keywords, sha256(x.content) AS sha FROM ended",
    "anchored_windows": """WITH RECURSIVE own AS (SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS t, event_id FROM events),
      walk AS (SELECT user_id, min(t) AS anchor FROM own GROUP BY 1 UNION ALL SELECT user_id, t FROM (SELECT w.user_id, o.t, row_number() OVER (PARTITION BY w.user_id ORDER BY o.t) AS place FROM walk w JOIN own o ON o.user_id = w.user_id AND o.t >= w.anchor + 86400000000) WHERE place = 1)
      SELECT w.user_id, anchor, string_agg(event_id || ';', '' ORDER BY t, event_id) AS content, count(*) AS n FROM walk w JOIN own o ON o.user_id = w.user_id AND t >= anchor AND t < anchor + 86400000000 GROUP BY 1, 2""",
    "response_steps": f"""WITH {TIMED}, ups AS (
        SELECT *, 1 AS event, CASE WHEN type = 'failure' THEN false END AS up FROM timed UNION ALL SELECT request_id, n + 12, NULL, NULL, NULL, 0, true FROM timed WHERE type = 'failure'
      ), run AS (
        SELECT request_id, n, type, event,
          coalesce(last_value(CASE type WHEN 'open' THEN 'research' WHEN 'sources' THEN 'prompt' WHEN 'user' THEN 'output' WHEN 'close' THEN 'done' WHEN 'failure' THEN 'initial' END IGNORE NULLS) OVER w, 'initial') AS step,
          coalesce(last_value(up IGNORE NULLS) OVER w, true) AS available, coalesce(last_value(tokens IGNORE NULLS) OVER w, 0) AS tokens_so_far, round(coalesce(sum(kwh * 3.25::DOUBLE) FILTER ({_OWN}) OVER w, 0.0::DOUBLE), 9) AS kwh_so_far
        FROM ups WINDOW w AS (PARTITION BY request_id ORDER BY n, event ROWS UNBOUNDED PRECEDING)
      ) SELECT request_id, n AS seq, type, step, available, tokens_so_far, kwh_so_far AS "kWh_so_far" FROM run WHERE event = 1""",
    "response_totals": f"""WITH {TIMED}, closes AS (SELECT request_id, min(n) AS closed_at FROM timed WHERE type = 'close' GROUP BY 1)
      SELECT c.request_id, closed_at, coalesce(arg_max(tokens, n) FILTER (type = 'sources'), 0) AS tokens, count(kwh) AS n_power, round(coalesce(sum(kwh * 3.25::DOUBLE) FILTER ({_OWN}), 0.0::DOUBLE), 9) AS "per_query_kWh",
        round(coalesce(sum(kwh), 0.0::DOUBLE), 9) AS "cpu_kWh", round(coalesce(sum(kwh * 2), 0.0::DOUBLE), 9) AS "gpu_kWh", round(coalesce(sum(kwh / 4), 0.0::DOUBLE), 9) AS "ram_kWh", round(coalesce(sum(kwh * 3.25::DOUBLE), 0.0::DOUBLE), 9) AS "total_kWh", round(coalesce(sum(CASE WHEN kwh IS NOT NULL THEN 10.0::DOUBLE END), 0.0::DOUBLE), 9) AS duration
      FROM closes c LEFT JOIN timed t ON t.request_id = c.request_id AND t.n < closed_at GROUP BY 1, 2""",
}
