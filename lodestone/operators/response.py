"""What a response looks like to its reader: output joined in short windows, the step it is at, and its totals at the close."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions import numbers

#: Energy of a power event; power_index isn't the query's own.
ENERGY = ("cpu_kWh", "gpu_kWh", "ram_kWh", "total_kWh", "duration")


def _anchors(time: np.ndarray, start: int | None, length: int) -> np.ndarray:
    """The window's start of each of one key's ascending times: the first time past a window opens the next. start: of the window that is open."""
    out = np.empty(len(time), np.int64)
    at = 0
    while at < len(time):
        if start is None or time[at] >= start + length:
            start = int(time[at])
        end = int(np.searchsorted(time, start + length))
        out[at:end] = start
        at = end
    return out


def anchored(parts: DataFrame, key: str, micros: Column, length: int) -> DataFrame:
    """parts with `anchor`, the start in microseconds of the window that each is in; rows without a time go.

    A key's first part opens a window of `length` microseconds, and the first part after it opens the next. Where a
    window begins so depends on the one before: the parts of a key stream by in order, and only the open window is held.
    """
    timed = parts.withColumn("anchor", micros.cast("long")).where("anchor IS NOT NULL")
    last = len(timed.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, start = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, time = b.column(key), b.column(last).to_numpy()
            codes = keys.dictionary_encode().indices
            cuts = np.flatnonzero(np.diff(pc.fill_null(codes, -1).to_numpy(zero_copy_only=False))) + 1
            anchor = np.empty(len(time), np.int64)
            for at, end in zip([0, *cuts], [*cuts, len(time)], strict=True):
                own = (keys[at].as_py(),)
                anchor[at:end] = _anchors(time[at:end], start if own == held else None, length)
                held, start = own, int(anchor[end - 1])
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(anchor)], schema=b.schema)

    schema = StructType([f for f in timed.schema.fields if f.name != "anchor"]).add("anchor", LongType())
    return timed.repartition(key).sortWithinPartitions(key, "anchor").mapInArrow(run, schema)


def coalesced(parts: DataFrame, key: str = "request_id", length: int = 100_000) -> DataFrame:
    """(key, anchor, content, n): parts (key, ts, seq, content) put together as the reader sees them, a window from its first part on."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "content"))), lambda x: x["content"]), "")
    return anchored(parts, key, F.unix_micros("ts"), length).groupBy(key, "anchor").agg(joined.alias("content"), F.count("*").alias("n"))


def steps(events: DataFrame, retry_seconds: int = 12) -> DataFrame:
    """events (request_id, seq, ts, type, total_kWh, tokens) with step, available, tokens_so_far and kWh_so_far.

    Every event either puts the response at a step or leaves it where it is, so that of all events up to one the last
    that puts it anywhere tells the step; initial before any. A failure takes the service away and arms a timer that
    brings it back after retry_seconds, whatever failed meanwhile: of both, too, the last tells. tokens are those of
    the last sources event, kWh the sum over power events of all kinds but power_index. Times of equal order go by seq,
    timers first.
    """
    known = F.create_map(*[F.lit(x) for kv in numbers.STEPS.items() for x in kv])
    failed = F.col("type") == "failure"
    timers = events.where(failed).select("request_id", (F.col("ts") + F.make_interval(secs=F.lit(retry_seconds))).alias("ts"), F.lit(True).alias("up"))
    both = events.withColumn("up", F.when(failed, F.lit(False))).withColumn("event", F.lit(1)).unionByName(timers.withColumn("event", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy("request_id").orderBy("ts", "event", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = (F.col("type").startswith("power_")) & (F.col("type") != "power_index")
    run = both.withColumns(
        {
            "step": F.coalesce(F.last(F.element_at(known, F.coalesce("type", F.lit(""))), ignorenulls=True).over(upto), F.lit("initial")),
            "available": F.coalesce(F.last("up", ignorenulls=True).over(upto), F.lit(True)),
            "tokens_so_far": F.coalesce(F.last(F.when(F.col("type") == "sources", F.col("tokens")), ignorenulls=True).over(upto), F.lit(0).cast("long")),
            "kWh_so_far": F.coalesce(F.sum(F.when(own, F.col("total_kWh"))).over(upto), F.lit(0.0)),
        }
    )
    return run.where("event = 1").drop("event", "up")


def totals(events: DataFrame) -> DataFrame:
    """(request_id, closed_at, tokens, n_power, per_query_kWh, ENERGY): one row for each request with a close event, over its events up to the first one. What comes after it, and requests still open, count for nothing.

    The close meets its events by partial aggregates: seq of the close is found first, and only sums travel.
    """
    closes = events.where("type = 'close'").groupBy(F.col("request_id").alias("of")).agg(F.min("seq").alias("closed_at"))
    kept = events.where(F.col("type").startswith("power_") | (F.col("type") == "sources"))
    met = closes.join(kept, (F.col("of") == F.col("request_id")) & (F.col("seq") < F.col("closed_at")), "left")
    power = F.col("type").startswith("power_")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return met.groupBy(F.col("of").alias("request_id")).agg(
        F.first("closed_at").alias("closed_at"),
        F.coalesce(F.max_by("tokens", F.when(F.col("type") == "sources", F.col("seq"))), F.lit(0).cast("long")).alias("tokens"),
        F.count_if(power).alias("n_power"),
        zero(F.sum(F.when(power & (F.col("type") != "power_index"), F.col("total_kWh")))).alias("per_query_kWh"),
        *[zero(F.sum(F.when(power, F.col(c)))).alias(c) for c in ENERGY],
    )
