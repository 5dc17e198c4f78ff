"""The event stream of a response, its frames, its tracking, and queue positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of a response's events, and which of them are tracked.
ORDER = ["heartbeat", "queue_position", "power_index", "sources", "power_prompt", "user", "assistant", "power_response"]
TRACKED = ["power_index", "sources", "power_prompt", "user", "assistant", "power_response"]


def frame(type_: Column, content: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(type_.alias("type"), content.alias("content"))), F.lit("\n\n"))


def parse(frames: Column, content: str) -> Column:
    """The event in a frame, with content of a given type; null for an empty or broken frame."""
    body = F.regexp_extract(frames, r"(?s)\Adata: (.*?)\n\n\z", 1)
    return F.from_json(F.nullif(body, F.lit("")), f"type string, content {content}")


def response_events(requests: DataFrame, parts: DataFrame, known: DataFrame) -> DataFrame:
    """(request_id, seq, type, content): all events of each request (request_id, dataset_id, position, prompt), with its answer's parts (request_id, part_no, part); an unknown data set gives one error."""
    of = requests.join(known, "dataset_id", "left_semi")
    fixed = {
        "heartbeat": F.lit(""),
        "queue_position": F.col("position").cast("string"),
        "power_index": F.lit("{}"),
        "sources": F.lit("[]"),
        "power_prompt": F.lit("{}"),
        "user": F.col("prompt"),
        "power_response": F.lit("{}"),
    }
    rank = {k: i for i, k in enumerate(ORDER)}
    single = of.select("request_id", F.inline(F.array(*[F.struct(F.lit(rank[k]).alias("rank"), F.lit(0).cast("long").alias("part_no"), F.lit(k).alias("type"), v.alias("content")) for k, v in fixed.items()])))
    answer = parts.join(of.select("request_id"), "request_id", "left_semi").select("request_id", F.lit(rank["assistant"]).alias("rank"), F.col("part_no").cast("long").alias("part_no"), F.lit("assistant").alias("type"), F.col("part").alias("content"))
    errors = unknown(requests, known).select("request_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("part_no"), F.lit("error").alias("type"), F.col("detail").alias("content"))
    every = single.unionByName(answer).unionByName(errors)
    seq = F.row_number().over(Window.partitionBy("request_id").orderBy("rank", "part_no")) - 1
    return every.select("request_id", seq.alias("seq"), "type", "content")


def unknown(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests for data sets that there aren't."""
    return requests.join(known, "dataset_id", "left_anti").withColumn("status", F.lit(404)).withColumn("detail", F.concat(F.lit("Dataset not found: "), F.coalesce("dataset_id", F.lit(""))))


def answers(parts: DataFrame) -> DataFrame:
    """The whole answer of each request, and the time of the last part that told one."""
    timed = F.col("load_ns").isNotNull() & F.col("eval_ns").isNotNull() & F.col("prompt_eval_ns").isNotNull()
    seconds = (F.col("load_ns") + F.col("eval_ns") + F.col("prompt_eval_ns")) / 1e9
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "part")))
    return parts.groupBy("request_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("answer"), F.coalesce(F.max_by(F.when(timed, seconds), F.when(timed, F.col("part_no"))), F.lit(0.0)).alias("seconds"))


def tracking(events: DataFrame, site: str) -> DataFrame:
    """What is tracked of response events: one row a request and type, the answer in one."""
    of = events.where(F.col("type").isin(TRACKED)).groupBy("request_id", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "").alias("value"))
    return of.select(F.lit(site).alias("idsite"), F.lit(1).alias("rec"), F.lit("chat").alias("e_c"), F.col("type").alias("e_a"), F.col("request_id").alias("_id"), F.col("value").alias("e_n"), F.length("value").alias("e_v"))


def active_requests(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """active: a counter over changes (+1 or -1) that doesn't go below zero, as the running sum less its lowest point so far."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = changes.withColumn("sum", F.sum("change").over(upto))
    return run.withColumn("active", F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto))).drop("sum")


def open_requests(changes: DataFrame, limit_seconds: float) -> DataFrame:
    """(key, request_id, ts, seq, change, abandoned, active) of changes (key, request_id, ts, seq, change, +1 or -1): how many requests are open after each.

    A request begins with its first start. It ends with the first end after that, or limit_seconds after it begins, as
    abandoned, a row of its own with a null seq. Other starts and ends count for nothing. At equal times those given up
    go first (by when they began), then ends, then starts, each by seq.
    """
    begun = changes.where("change > 0").groupBy("key", "request_id").agg(F.min(F.struct("ts", "seq")).alias("b"))
    ends = changes.where("change < 0").select(F.col("key").alias("k"), F.col("request_id").alias("r"), "ts", "seq")
    met = begun.join(ends, (F.col("key") == F.col("k")) & (F.col("request_id") == F.col("r")) & (F.col("ts") >= F.col("b.ts")), "left")
    first = met.groupBy("key", "request_id").agg(F.first("b").alias("b"), F.min(F.struct("ts", "seq")).alias("e"))
    limit = F.col("b.ts") + F.make_interval(secs=F.lit(limit_seconds))
    in_time = F.coalesce(F.col("e.ts") < limit, F.lit(False))
    row = lambda ts, seq, change, abandoned, rank: F.struct(ts.alias("ts"), seq.cast("long").alias("seq"), F.lit(change).alias("change"), abandoned.alias("abandoned"), rank.alias("rank"))
    start = row(F.col("b.ts"), F.col("b.seq"), 1, F.lit(False), F.lit(2))
    end = row(F.when(in_time, F.col("e.ts")).otherwise(limit), F.when(in_time, F.col("e.seq")), -1, ~in_time, in_time.cast("int"))
    rows = first.select("key", "request_id", F.inline(F.array(start, end)))
    upto = Window.partitionBy("key").orderBy("ts", "rank", "seq", "request_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("active", F.sum("change").over(upto)).drop("rank")


def captcha(solution: Column, key: str | None, override: str | None, verified: Column) -> Column:
    """The gate's verdict: pass, 400 without a solution, else what the outside check said."""
    if not key:
        return F.lit("pass")
    own = (solution == F.lit(override)) if override else F.lit(False)
    return F.when(own & (solution != ""), "pass").when(F.coalesce(solution, F.lit("")) == "", "400").when(verified, "pass").otherwise("400")
