"""Queries of corpus preparation, annotation, energy, events and streams. `documents` stands for corpora, `conversations` for requests, `events` for telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import align, annotate, events, power, validate
from .retrieval import read


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with blank lines and odd spaces put in, which they don't have themselves."""
    return docs(spark, sf_dir).withColumn("text", F.concat(F.lit("  \n\n"), F.replace("text", F.lit(". "), F.lit(".  \t ")), F.lit("\n \n ")))


MESSY = "messy AS (SELECT doc_id, lang, chr(160) || ' ' || chr(10) || chr(10) || replace(text, '. ', '.' || chr(160) || ' ' || chr(9) || ' ') || chr(10) || ' ' || chr(10) || chr(8195) AS text FROM documents)"
RE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def nonblank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.nonblank_lines(F.col("text"))
    return messy(spark, sf_dir).select("doc_id", F.size(lines).alias("n_lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))


def normalize_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir).select("doc_id", F.sha2(text.normalize_spaces(F.col("text")), 256).alias("sha"))


def regulation(c: Column) -> Column:
    """A document as a regulation: headings, titles, enumerators, each on lines of their own."""
    return F.concat(F.lit("KAPITEL IV\n\n"), c, F.lit("\nABSCHNITT 2\n"), c, F.lit("\nArtikel 7\nTitle\n(1)\n"), c, F.lit("\na)\n"), c, F.lit("\n12.\nend"))


def heading_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split(regulation(F.col("text")), "\n"), text.heading)
    return docs(spark, sf_dir).select("doc_id", F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))


def subtitle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("# KAPITEL IV\n"), F.col("text"), F.lit("\n### Artikel 7\nTitle\nANHANG X\nmore"))
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.join_titles(marked), 256).alias("sha"))


def enumerator_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.join_numbers(regulation(F.col("text"))), 256).alias("sha"))


def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of a regulation's preparation; its parts have SQL of their own."""
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.preprocess(regulation(F.col("text"))), 256).alias("sha"))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.preview(F.col("text")).alias("preview"), F.length("text").alias("n_chars"))


def title_filter(spark: SparkSession, sf_dir: str, prefix: str = "Service ") -> DataFrame:
    """Documents whose title isn't empty and doesn't begin with a prefix."""
    titled = docs(spark, sf_dir).withColumn("title", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(prefix), F.col("source"))).when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise(""))
    return titled.where((F.col("title") != "") & ~F.startswith("title", F.lit(prefix))).select("doc_id", "title")


def base64_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.base64(F.col("text")).alias("encoded"), F.length(F.decode(F.unbase64(text.base64(F.col("text"))), "UTF-8")).alias("n_chars"))


def prefix_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    reference = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line_no"), F.col("text").alias("ref"))
    return align.first_prefix_match(lines, reference).where("line_no IS NOT NULL").groupBy("doc_id", "line_no").agg(F.count("*").alias("n"))


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return align.zip_lines(lines.withColumnRenamed("doc_id", "doc"), lines.select((F.col("doc_id") - 1).alias("doc"), "line_no", "text")).select(F.col("doc").alias("doc_id"), "line_no", F.length("text").alias("n"), F.length("other").alias("n_other"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents cut in the middle of a reference's lines, and lines it hasn't."""
    reference = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line_no"), text.normalize_spaces(F.col("text")).alias("de"), F.concat(F.lit("EN "), F.col("item_id").cast("string")).alias("en"))
    words = F.split("de", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    built = reference.select(F.col("line_no").cast("int").alias("chunk_idx"), F.array(part(F.lit(1), F.lit(4)), F.lit(""), part(F.lit(5), F.greatest(F.size(words) - 4, F.lit(0))), F.lit("Q q q")).alias("lines"))
    own = docs(spark, sf_dir).select((F.col("doc_id") + 1_000_000).cast("int").alias("chunk_idx"), F.transform(F.split("text", "\n"), text.normalize_spaces).alias("lines"))
    return align.align(built.unionByName(own), reference)


def align_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over each chunk."""
    return align.consolidate(aligned(spark, sf_dir)).select("chunk_idx", F.sha2("content", 256).alias("content_sha"), F.sha2("original_content", 256).alias("original_sha"))


def align_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.unmatched(aligned(spark, sf_dir)).groupBy("chunk_idx").agg(F.count("*").alias("n_unmatched"))


# --- annotation -------------------------------------------------------------------------


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of items: the user's turns are chunks."""
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "chunk").otherwise("text")
    return c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), kind.alias("kind"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.when(kind == "chunk", "").alias("title"), F.col("text").alias("content"), F.array().cast("array<string>").alias("relevantChunksIds"))


def with_blanks(items_: DataFrame) -> DataFrame:
    """A blank text and a blank chunk at the end of every conversation."""
    last = items_.groupBy("doc").agg(F.max("ord").alias("last"))
    blank = lambda n, kind: last.select("doc", (F.col("last") + n).alias("ord"), F.lit(kind).alias("kind"), F.concat_ws("/", F.lit("blank"), F.col("doc").cast("string"), F.lit(str(n))).alias("id"), F.lit(None).cast("string").alias("title"), F.lit(" \n ").alias("content"), F.array().cast("array<string>").alias("relevantChunksIds"))
    return items_.unionByName(blank(1, "chunk")).unionByName(blank(2, "text"))


ITEMS = "items AS (SELECT conv_id AS doc, turn AS ord, CASE WHEN role = 'user' THEN 'chunk' ELSE 'text' END AS kind, conv_id || '/' || turn AS id, text AS content FROM conversations)"
BLANKS = f"""plain_{ITEMS}, ends AS (SELECT doc, max(ord) AS top FROM plain_items GROUP BY 1),
items AS (SELECT * FROM plain_items UNION ALL SELECT doc, top + 1, 'chunk', 'blank/' || doc || '/1', ' ' || chr(10) || ' ' FROM ends UNION ALL SELECT doc, top + 2, 'text', 'blank/' || doc || '/2', ' ' || chr(10) || ' ' FROM ends)"""


def create_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = items(spark, sf_dir)
    third = F.floor(F.length("content") / 3)
    selected = own.select("doc", "id", third.alias("start"), (third * 2).alias("end"))
    return annotate.create_chunk(own, selected).select("doc", "ord", "kind", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("sha"))


def delete_chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of every second conversation goes; blank items stay in the others alone."""
    own = with_blanks(items(spark, sf_dir))
    deleted = own.where("kind = 'chunk' AND doc % 2 = 0").groupBy("doc").agg(F.min_by("id", "ord").alias("id"))
    return annotate.delete_chunk(own, deleted).select("doc", "ord", "kind", F.sha2("content", 256).alias("sha"))


def update_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.update_property(items(spark, sf_dir), "0/0", "title", F.lit("new")).select("id", "title")


def related_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.related_options(items(spark, sf_dir))


def tag_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.col("lang"), F.col("source"))
    new = F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, " ").otherwise("new")
    joined = lambda c: F.array_join(c, ",")
    return docs(spark, sf_dir).select("doc_id", joined(annotate.add_tag(tags, new)).alias("added"), joined(annotate.select_option(tags, new)).alias("selected"), joined(annotate.remove_tag(tags, new)).alias("removed"))


def option_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(annotate.matching_option(F.col("source"), F.col("lang"), F.lit("SRC1"), F.array(F.lit("de")))).select("doc_id", "source", "lang")


# --- configuration and requests -----------------------------------------------------------


def dataset_prompt_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("dataset_id"))
    return validate.inconsistent(a, read(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("dataset_id")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), (F.col("conv_id") % 7).cast("string").alias("dataset_id"), F.col("text").alias("prompt"), (F.col("turn") + 1).alias("position"))


REQUESTS = "requests AS (SELECT conv_id || '/' || turn AS request_id, CAST(conv_id % 7 AS VARCHAR) AS dataset_id, text AS prompt, turn + 1 AS position FROM conversations WHERE role = 'user')"


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select((F.col("label") % 5).cast("string").alias("dataset_id")).distinct()


KNOWN = "known AS (SELECT DISTINCT CAST(label % 5 AS VARCHAR) AS dataset_id FROM embeddings)"


def unknown_dataset_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.unknown(requests(spark, sf_dir), known(spark, sf_dir)).select("request_id", "dataset_id", "status", "detail")


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "documents").select("doc_id", validate.request_valid(F.col("text"), F.col("lang")).alias("valid"))
    return asked.groupBy("valid").agg(F.count("*").alias("n"))


def captcha_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    solution = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    verdict = events.captcha(solution, "key", "click", F.col("value") > 50)
    return e.groupBy("event_type", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's words as parts of the answer to the turn before."""
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    split = c.select("conv_id", "turn", F.posexplode(F.split("text", "(?<= )")).alias("part_no", "part"))
    ns = lambda k: F.when(F.col("part_no") % 2 == 0, F.col("part_no") * k + F.col("turn"))
    return split.select(F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("request_id"), "part_no", "part", ns(1000).alias("load_ns"), ns(2000).alias("eval_ns"), (F.col("part_no") * 10).alias("prompt_eval_ns"))


def response_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.response_events(requests(spark, sf_dir), parts(spark, sf_dir), known(spark, sf_dir))


RESPONSE = (
    f"{REQUESTS}, {KNOWN}"
    + """, words AS (SELECT conv_id || '/' || (turn - 1) AS request_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS part_no, len(string_split(text, ' ')) AS n FROM conversations WHERE role = 'assistant'),
parts AS (SELECT request_id, turn, part_no, CASE WHEN part_no < n - 1 THEN w || ' ' ELSE w END AS part FROM words),
good AS (SELECT * FROM requests WHERE dataset_id IN (SELECT dataset_id FROM known)),
ev AS (
  SELECT request_id, 0 AS rank, 0 AS part_no, 'heartbeat' AS type, '' AS content FROM good
  UNION ALL SELECT request_id, 1, 0, 'queue_position', CAST(position AS VARCHAR) FROM good UNION ALL SELECT request_id, 2, 0, 'power_index', '{}' FROM good
  UNION ALL SELECT request_id, 3, 0, 'sources', '[]' FROM good UNION ALL SELECT request_id, 4, 0, 'power_prompt', '{}' FROM good
  UNION ALL SELECT request_id, 5, 0, 'user', prompt FROM good UNION ALL SELECT request_id, 7, 0, 'power_response', '{}' FROM good
  UNION ALL SELECT p.request_id, 6, p.part_no, 'assistant', p.part FROM parts p WHERE p.request_id IN (SELECT request_id FROM good)
  UNION ALL SELECT request_id, 0, 0, 'error', 'Dataset not found: ' || dataset_id FROM requests WHERE dataset_id NOT IN (SELECT dataset_id FROM known)
), response AS (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rank, part_no) - 1 AS INTEGER) AS seq, type, content FROM ev)"""
)


def response_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.answers(parts(spark, sf_dir)).select("request_id", F.sha2("answer", 256).alias("sha"), "seconds")


def tracking_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.tracking(response_events(spark, sf_dir), "1")


def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, read back: parsed values are what counts."""
    framed = read(spark, sf_dir, "conversations").select("conv_id", "turn", events.frame(F.col("role"), F.col("text")).alias("frame"))
    back = framed.withColumn("e", events.parse(F.col("frame"), "string"))
    return back.select("conv_id", "turn", F.col("e.type").alias("type"), F.sha2("e.content", 256).alias("sha"), F.endswith("frame", F.lit("\n\n")).alias("ends"))


def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON inside JSON: an event whose content is a text of JSON."""
    framed = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "data: {broken\n\n").otherwise(events.frame(F.col("event_type"), F.col("props"))).alias("frame"))
    e = events.parse(F.col("frame"), "string")
    return framed.select("event_id", e["type"].alias("type"), F.from_json(e["content"], "k bigint")["k"].alias("k"))


# --- energy and queues -------------------------------------------------------------------


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.col("value").alias("cpu_watts"), (F.col("value") * 2).alias("gpu_watts"), (F.col("value") / 4).alias("ram_watts"), "ts")


def median_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = power.medians(samples(spark, sf_dir), "event_type")
    return found.select("event_type", *[F.round(f"{p}_watts", 6).alias(f"{p}_watts") for p in power.PARTS])


def power_kwh(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = power.energy(samples(spark, sf_dir).withColumn("seconds", (F.col("event_id") % 60).cast("double")), "seconds")
    return used.select("event_id", *[F.round(c, 12).alias(c) for c in ("cpu_kWh", "gpu_kWh", "ram_kWh", "total_kWh")], "duration")


def cumulative_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = samples(spark, sf_dir).withColumn("joules", F.round(F.sum("cpu_watts").over(own.rowsBetween(Window.unboundedPreceding, 0)), 6)).withColumn("n", F.row_number().over(own).cast("double"))
    return power.since_start(run, "user_id", "n", "joules").select("event_id", F.round("watts", 9).alias("watts"))


def energy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(F.lit("power_index"), F.lit("power_prompt"), F.lit("power_response")), (F.col("event_id") % 3 + 1).cast("int"))
    used = power.energy(samples(spark, sf_dir).withColumn("seconds", F.lit(10.0)), "seconds")
    return used.withColumn("name", name)


def power_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = power.totals(energy_events(spark, sf_dir), "user_id")
    return total.select("user_id", *[F.round(c, 12).alias(c) for c in total.columns if c != "user_id"])


ENERGY = "energy AS (SELECT user_id, event_id % 3 AS k, value * 10 / 3600 / 1000 AS c, value * 2 * 10 / 3600 / 1000 AS g, value / 4 * 10 / 3600 / 1000 AS r FROM events)"


def energy_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = energy_events(spark, sf_dir).groupBy("user_id").agg(F.round(F.sum("total_kWh"), 12).alias("kWh"))
    return total.select("user_id", "kWh", F.round(numbers.hair_dryer_seconds(F.col("kWh")), 5).alias("hair_dryer_seconds"), F.round(numbers.phone_battery_percent(F.col("kWh")), 5).alias("phone_percent"))


def active_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    changes = e.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("change"))
    return events.active_requests(changes, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "active")


ACTIVE = """ch AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('signup', 'purchase')),
su AS (SELECT *, sum(d) OVER w AS s FROM ch WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
act AS (SELECT user_id, event_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS active FROM su)"""


def queue_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = numbers.queue_seconds(F.col("active"))
    return active_requests(spark, sf_dir).select("event_id", "active", seconds.alias("seconds"), numbers.queue_message(F.col("active"), seconds).alias("message"), F.round(numbers.progress_percent(F.col("active").cast("double"), F.col("active") > 2), 6).alias("percent"))


def coalesce_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), "").alias("content")).select("user_id", F.unix_seconds("w.start").alias("start"), "content")


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: events and values by day and type."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.unix_date(F.to_date("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions of each user, a gap of 30 minutes apart."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_seconds("w.start").alias("start"), "n")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count("*").alias("n"))


def score_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.round(F.col("value") / 100, 4).alias("score"), numbers.percent(F.col("value") / 1000).alias("percent"), numbers.german_decimal(F.col("value"), 1).alias("tenths"), numbers.german_decimal(F.col("value") / 1000, 6).alias("millionths"), numbers.german_integer(F.col("event_id") * 12345).alias("grouped"), F.round(numbers.gib(F.col("event_id") * 1e9), 6).alias("gib"), F.round(numbers.seconds_from_nano(F.col("event_id") * 1000), 9).alias("seconds"))


#: printf rounds exact halves to even places, toFixed() up; with one place, only odd quarters are halves.
TIE = "CASE WHEN {0} * 4 = floor({0} * 4) AND CAST(floor({0} * 4) AS BIGINT) % 2 = 1 THEN {0} + 0.01 ELSE {0} END"
#: A walk over the lines of each chunk: a row is the line at hand; taking counts those that a reference line has taken on from it.
ALIGNED = f"""ref AS (SELECT item_id AS line_no, trim(regexp_replace(text, '{RE_SPACE}+', ' ', 'g')) AS de, 'EN ' || item_id AS en FROM benchmark),
built AS (SELECT CAST(line_no AS INTEGER) AS chunk_idx, [array_to_string(string_split(de, ' ')[1:4], ' '), '', array_to_string(string_split(de, ' ')[5:], ' '), 'Q q q'] AS lines FROM ref),
own AS (SELECT CAST(doc_id + 1000000 AS INTEGER) AS chunk_idx, list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '{RE_SPACE}+', ' ', 'g'))) AS lines FROM documents),
line AS (SELECT chunk_idx, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM (SELECT * FROM built UNION ALL SELECT * FROM own)),
distinct_line AS (SELECT DISTINCT line FROM line WHERE line <> ''),
hit AS (SELECT line, min(line_no) AS line_no FROM distinct_line JOIN ref ON starts_with(de, line) GROUP BY 1),
starts AS (SELECT l.chunk_idx, l.place, l.line, r.de, r.en FROM line l JOIN hit h USING (line) JOIN ref r ON r.line_no = h.line_no),
run AS (
  SELECT chunk_idx, place, de, line AS whole, place AS upto, 1 AS taken FROM starts
  UNION ALL
  SELECT r.chunk_idx, r.place, r.de, CASE WHEN l.line = '' THEN r.whole ELSE r.whole || ' ' || l.line END, l.place, r.taken + CASE WHEN l.line = '' THEN 0 ELSE 1 END
  FROM run r JOIN line l ON l.chunk_idx = r.chunk_idx AND l.place = r.upto + 1 WHERE l.line = '' OR starts_with(r.de, r.whole || ' ' || l.line)
), took AS (SELECT chunk_idx, place, max(taken) AS taken FROM run GROUP BY 1, 2),
walk AS (
  SELECT chunk_idx, 1::BIGINT AS place FROM (SELECT DISTINCT chunk_idx FROM line)
  UNION ALL
  SELECT w.chunk_idx, w.place + coalesce(t.taken, 1) FROM walk w JOIN line l ON l.chunk_idx = w.chunk_idx AND l.place = w.place LEFT JOIN took t ON t.chunk_idx = w.chunk_idx AND t.place = w.place
), entries AS (
  SELECT w.chunk_idx, w.place, coalesce(s.de, l.line) AS original_content, coalesce(s.en, '') AS content, s.de IS NOT NULL AS matched
  FROM walk w JOIN line l ON l.chunk_idx = w.chunk_idx AND l.place = w.place LEFT JOIN starts s ON s.chunk_idx = w.chunk_idx AND s.place = w.place WHERE l.line <> ''
)"""

QUERIES = {
    f.__name__: f
    for f in (nonblank_lines, normalize_spaces, heading_markup, subtitle_join, enumerator_join, preprocess, previews, title_filter, base64_text, prefix_first_match, positional_zip, align_consolidate, align_unmatched, create_chunk, delete_chunk_merge, update_property, related_options, tag_edit, option_search, dataset_prompt_consistency, unknown_dataset_errors, request_validation, captcha_gate, response_events, response_concat, tracking_events, sse_frames, sse_parse, median_power, power_kwh, cumulative_power, power_totals, energy_equivalents, active_requests, queue_eta, coalesce_windows, tumbling_windows, session_windows, json_props, score_formats)
}
REGULATION = "'KAPITEL IV' || chr(10) || chr(10) || text || chr(10) || 'ABSCHNITT 2' || chr(10) || text || chr(10) || 'Artikel 7' || chr(10) || 'Title' || chr(10) || '(1)' || chr(10) || text || chr(10) || 'a)' || chr(10) || text || chr(10) || '12.' || chr(10) || 'end'"
SQL = {
    "nonblank_lines": f"WITH {MESSY}, l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '{RE_SPACE}*')) AS ls FROM messy) SELECT doc_id, CAST(len(ls) AS INTEGER) AS n_lines, sha256(array_to_string(ls, chr(10))) AS sha FROM l",
    "normalize_spaces": f"WITH {MESSY} SELECT doc_id, sha256(trim(regexp_replace(text, '{RE_SPACE}+', ' ', 'g'))) AS sha FROM messy",
    "heading_markup": f"SELECT doc_id, sha256(array_to_string(list_transform(string_split({REGULATION}, chr(10)), lambda l: CASE WHEN starts_with(l, 'KAPITEL') THEN '# ' || l WHEN starts_with(l, 'ABSCHNITT') THEN '## ' || l WHEN starts_with(l, 'Artikel') THEN '### ' || l ELSE l END), chr(10))) AS sha FROM documents",
    "subtitle_join": r"SELECT doc_id, sha256(regexp_replace('# KAPITEL IV' || chr(10) || text || chr(10) || '### Artikel 7' || chr(10) || 'Title' || chr(10) || 'ANHANG X' || chr(10) || 'more', '(# KAPITEL\s+[IVXLCDM]+|## ABSCHNITT\s+\d+|ANHANG\s+[IVXLCDM]+)\n([^\n]+)|(### \bArtikel\s+\d+)\n([^\n]+)', '\1\3: \2\4', 'g')) AS sha FROM documents",
    "enumerator_join": rf"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace({REGULATION}, '\((\d+)\)\s*\n', '(\1) ', 'g'), '([a-z])\)\s*\n', '\1) ', 'g'), '(\d+)\.\s*\n', '\1. ', 'g')) AS sha FROM documents",
    "preprocess": rf"""WITH r AS (SELECT doc_id, trim(regexp_replace({REGULATION}, '\n{RE_SPACE}*\n', chr(10), 'g')) AS t FROM documents),
      h AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda l: CASE WHEN starts_with(l, 'KAPITEL') THEN '# ' || l WHEN starts_with(l, 'ABSCHNITT') THEN '## ' || l WHEN starts_with(l, 'Artikel') THEN '### ' || l ELSE l END), chr(10)) AS t FROM r),
      j AS (SELECT doc_id, regexp_replace(t, '(# KAPITEL\s+[IVXLCDM]+|## ABSCHNITT\s+\d+|ANHANG\s+[IVXLCDM]+)\n([^\n]+)|(### \bArtikel\s+\d+)\n([^\n]+)', '\1\3: \2\4', 'g') AS t FROM h)
      SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, '\((\d+)\)\s*\n', '(\1) ', 'g'), '([a-z])\)\s*\n', '\1) ', 'g'), '(\d+)\.\s*\n', '\1. ', 'g')) AS sha FROM j""",
    "align_consolidate": f"WITH RECURSIVE {ALIGNED} SELECT chunk_idx, sha256(string_agg(content, chr(10) ORDER BY place)) AS content_sha, sha256(string_agg(original_content, chr(10) ORDER BY place)) AS original_sha FROM entries GROUP BY 1",
    "align_unmatched": f"WITH RECURSIVE {ALIGNED} SELECT chunk_idx, count(*) AS n_unmatched FROM entries WHERE NOT matched GROUP BY 1",
    "previews": "SELECT doc_id, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS preview, CAST(length(text) AS INTEGER) AS n_chars FROM documents",
    "title_filter": "SELECT doc_id, source AS title FROM documents WHERE doc_id % 3 = 1",
    "base64_text": "SELECT doc_id, to_base64(encode(text)) AS encoded, CAST(length(text) AS INTEGER) AS n_chars FROM documents",
    "prefix_first_match": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), d AS (SELECT line, min(item_id) AS line_no FROM (SELECT DISTINCT line FROM l) JOIN benchmark b ON starts_with(b.text, line) GROUP BY 1) SELECT doc_id, line_no, count(*) AS n FROM l JOIN d USING (line) GROUP BY 1, 2",
    "positional_zip": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) SELECT a.doc_id, CAST(a.line_no AS INTEGER) AS line_no, CAST(length(a.line) AS INTEGER) AS n, CAST(length(b.line) AS INTEGER) AS n_other FROM l a JOIN l b ON b.doc_id = a.doc_id + 1 AND a.line_no = b.line_no",
    "create_chunk": f"""WITH {ITEMS}, t AS (SELECT *, CAST(floor(length(content) / 3.0) AS BIGINT) AS k FROM items),
      p AS (SELECT doc, ord, 0 AS part, kind, content FROM t WHERE NOT (kind = 'text' AND k > 0)
        UNION ALL SELECT doc, ord, 0, 'text', trim(substr(content, 1, k), ' ' || chr(10) || chr(9)) FROM t WHERE kind = 'text' AND k > 0
        UNION ALL SELECT doc, ord, 1, 'chunk', trim(substr(content, k + 1, k), ' ' || chr(10) || chr(9)) FROM t WHERE kind = 'text' AND k > 0
        UNION ALL SELECT doc, ord, 2, 'text', trim(substr(content, 2 * k + 1), ' ' || chr(10) || chr(9)) FROM t WHERE kind = 'text' AND k > 0)
      SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY ord, part) - 1 AS INTEGER) AS ord, kind, CAST(length(content) AS INTEGER) AS n_chars, sha256(content) AS sha FROM p WHERE NOT (content = '' AND part <> 1 AND kind = 'text')""",
    "delete_chunk_merge": f"""WITH {BLANKS}, d AS (SELECT doc, min(ord) AS del FROM items WHERE kind = 'chunk' AND doc % 2 = 0 GROUP BY 1),
      n AS (SELECT i.*, del, lag(kind) OVER w AS before, lag(ord) OVER w AS ob, lead(ord) OVER w AS oa FROM items i LEFT JOIN d USING (doc) WINDOW w AS (PARTITION BY doc ORDER BY ord)),
      g AS (SELECT *, CASE WHEN ord = del THEN CASE WHEN before = 'text' THEN ob ELSE ord END WHEN kind = 'text' AND ob = del THEN coalesce((SELECT CASE WHEN x.before = 'text' THEN x.ob ELSE x.ord END FROM n x WHERE x.doc = n.doc AND x.ord = n.del), ord) ELSE ord END AS grp FROM n),
      m AS (SELECT doc, grp, CASE WHEN bool_or(coalesce(ord = del, false)) THEN 'text' ELSE min(kind) END AS kind, string_agg(content, '' ORDER BY ord) AS content FROM g GROUP BY 1, 2)
      SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY grp) - 1 AS INTEGER) AS ord, kind, sha256(content) AS sha FROM m WHERE doc NOT IN (SELECT doc FROM d) OR trim(content, ' ' || chr(10)) <> ''""",
    "update_property": f"WITH {ITEMS} SELECT id, CASE WHEN id = '0/0' THEN 'new' WHEN kind = 'chunk' THEN '' END AS title FROM items",
    "related_options": f"WITH {ITEMS} SELECT doc, id AS value, id AS label FROM items WHERE kind = 'chunk'",
    "tag_edit": "WITH t AS (SELECT doc_id, [lang, source] AS tags, CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN ' ' ELSE 'new' END AS v FROM documents) SELECT doc_id, array_to_string(CASE WHEN trim(v) <> '' AND NOT list_contains(tags, v) THEN list_append(tags, v) ELSE tags END, ',') AS added, array_to_string(CASE WHEN list_contains(tags, v) THEN tags ELSE list_append(tags, v) END, ',') AS selected, array_to_string(list_filter(tags, lambda x: x <> v), ',') AS removed FROM t",
    "option_search": "SELECT doc_id, source, lang FROM documents WHERE contains(lower(source), 'src1') AND lang <> 'de'",
    "dataset_prompt_consistency": "SELECT DISTINCT doc_id AS dataset_id, 'prompt' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id + 1 FROM labels) UNION ALL SELECT DISTINCT doc_id + 1, 'dataset' FROM labels WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents)",
    "unknown_dataset_errors": f"WITH {REQUESTS}, {KNOWN} SELECT request_id, dataset_id, 404 AS status, 'Dataset not found: ' || dataset_id AS detail FROM requests WHERE dataset_id NOT IN (SELECT dataset_id FROM known)",
    "request_validation": "SELECT length(text) BETWEEN 1 AND 500 AND length(lang) BETWEEN 1 AND 500 AS valid, count(*) AS n FROM documents GROUP BY 1",
    "captcha_gate": "WITH e AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS s, value FROM events) SELECT event_type, CASE WHEN s = 'click' THEN 'pass' WHEN s = '' THEN '400' WHEN value > 50 THEN 'pass' ELSE '400' END AS verdict, count(*) AS n FROM e GROUP BY 1, 2",
    "response_events": f"WITH {RESPONSE} SELECT request_id, seq, type, content FROM response",
    "response_concat": f"WITH {RESPONSE} SELECT request_id, sha256(string_agg(part, '' ORDER BY part_no)) AS sha, coalesce(arg_max((part_no * 3010 + 2 * turn) / 1e9, part_no) FILTER (part_no % 2 = 0), 0.0) AS seconds FROM parts GROUP BY 1",
    "tracking_events": f"WITH {RESPONSE} SELECT '1' AS idsite, 1 AS rec, 'chat' AS e_c, type AS e_a, request_id AS _id, string_agg(content, '' ORDER BY seq) AS e_n, CAST(length(string_agg(content, '' ORDER BY seq)) AS INTEGER) AS e_v FROM response WHERE type IN ('power_index', 'sources', 'power_prompt', 'user', 'assistant', 'power_response') GROUP BY request_id, type",
    "sse_frames": "SELECT conv_id, turn, role AS type, sha256(text) AS sha, true AS ends FROM conversations",
    "sse_parse": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS type, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
    "median_power": "SELECT event_type, round(median(value), 6) AS cpu_watts, round(median(value * 2), 6) AS gpu_watts, round(median(value / 4), 6) AS ram_watts FROM events GROUP BY 1",
    "power_kwh": "WITH s AS (SELECT event_id, value AS c, value * 2 AS g, value / 4 AS r, CAST(event_id % 60 AS DOUBLE) AS t FROM events) SELECT event_id, round(c * t / 3600 / 1000, 12) AS cpu_kWh, round(g * t / 3600 / 1000, 12) AS gpu_kWh, round(r * t / 3600 / 1000, 12) AS ram_kWh, round((c + g + r) * t / 3600 / 1000, 12) AS total_kWh, t AS duration FROM s",
    "cumulative_power": "WITH j AS (SELECT event_id, user_id, ts, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS j, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT event_id, CASE WHEN n > 1 THEN round(greatest(0.0, j - first_value(j) OVER (PARTITION BY user_id ORDER BY n)) / (n - 1), 9) END AS watts FROM j",
    "power_totals": f"WITH {ENERGY} SELECT user_id, round(coalesce(sum(c + g + r) FILTER (k <> 0), 0.0), 12) AS per_query_kWh, round(sum(c), 12) AS cpu_kWh, round(sum(g), 12) AS gpu_kWh, round(sum(r), 12) AS ram_kWh, round(sum(c + g + r), 12) AS total_kWh, round(sum(10.0::DOUBLE), 12) AS duration FROM energy GROUP BY 1",
    "energy_equivalents": f"WITH {ENERGY}, t AS (SELECT user_id, round(sum(c + g + r), 12) AS kWh FROM energy GROUP BY 1) SELECT user_id, kWh, round(kWh * 1000 / 2200 * 3600, 5) AS hair_dryer_seconds, round(kWh * 1000 / 5 * 1000 / 5000 * 0.8::DOUBLE * 100, 5) AS phone_percent FROM t",
    "active_requests": f"WITH {ACTIVE} SELECT user_id, event_id, active FROM act",
    "queue_eta": f"WITH {ACTIVE}, q AS (SELECT *, greatest(greatest(active, 1) - 1, 1) * 40 AS seconds FROM act) SELECT event_id, active, seconds, CASE WHEN active = 1 THEN '' WHEN active = 2 THEN '1 request waiting, seconds: ' || seconds ELSE 'requests waiting: ' || (active - 1) || ', seconds: ' || seconds END AS message, CASE WHEN active > 2 THEN 100.0::DOUBLE ELSE round(active / greatest(40.0::DOUBLE, active + 4.0::DOUBLE) * 100, 6) END AS percent FROM q",
    "coalesce_windows": "SELECT user_id, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, string_agg(CAST(event_id AS VARCHAR), '' ORDER BY ts, event_id) AS content FROM events GROUP BY user_id, time_bucket(INTERVAL 1 HOUR, ts)",
    "tumbling_windows": "SELECT CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "session_windows": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM n GROUP BY user_id, k",
    "json_props": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "score_formats": f"SELECT event_id, round(value / 100, 4) AS score, printf('%.1f%%', {TIE.format('value / 1000 * 100')}) AS percent, replace(printf('%.1f', {TIE.format('value')}), '.', ',') AS tenths, replace(printf('%.6f', value / 1000), '.', ',') AS millionths, replace(format('{{:,}}', event_id * 12345), ',', '.') AS grouped, round(event_id * 1e9 / 1073741824, 6) AS gib, round(event_id * 1000 / 1e9, 9) AS seconds FROM events",
}
