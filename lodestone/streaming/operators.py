"""Streams of events: counters that don't go below zero, output joined in short windows, dispatch by type, running totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACTIVE = "key string, seq long, change int, active long"


def active_requests(changes: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """changes (key, seq, change) with `active`, the counter after each; rows of a batch count in the order of seq. A key that stays idle for idle_ms is forgotten, and starts at zero again."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        active = state.get[0] if state.exists else 0
        rows = sorted((r for b in batches for r in zip(b["seq"].tolist(), b["change"].tolist(), strict=True)))
        out = []
        for seq, change in rows:
            active = max(0, active + change)
            out.append((key[0], seq, change, active))
        state.update((active,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "change", "active"])

    return changes.groupBy("key").applyInPandasWithState(step, ACTIVE, "active long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def utc(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need time stamps with a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def coalesced(parts: DataFrame, every: str = "100 milliseconds", late: str = "1 second") -> DataFrame:
    """(request_id, window, content): parts (request_id, ts, seq, content) put together in windows of time."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "")
    return parts.withWatermark("ts", late).groupBy("request_id", F.window("ts", every)).agg(joined.alias("content"))


class _Anchored(StatefulProcessor):
    """Holds parts until the watermark passes the end of the window that the first of them opened."""

    def __init__(self, length_ms: int) -> None:
        self.length = length_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "ms long, seq long, content string")

    def _flush(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        """All windows that are over; what is left waits for a timer at the end of its own."""
        held, out = sorted(self.parts.get()), []
        while held and held[0][0] + self.length <= watermark:
            anchor = held[0][0]
            inside = [x for x in held if x[0] < anchor + self.length]
            out.append((key[0], pd.Timestamp(anchor, unit="ms"), "".join(x[2] for x in inside), len(inside)))
            held = held[len(inside) :]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held:
            self.parts.put(held)
            self.handle.registerTimer(held[0][0] + self.length)
        else:
            self.parts.clear()
        if out:
            yield pd.DataFrame(out, columns=["request_id", "anchor", "content", "n"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(t), int(s), c or "") for b in rows for t, s, c in zip(b["ms"], b["seq"], b["content"], strict=True)]
        self.parts.appendList(new)
        yield from self._flush(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._flush(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def anchored(parts: DataFrame, length_ms: int = 100, late: str = "1 second") -> DataFrame:
    """(request_id, anchor, content, n): parts (request_id, ts, seq, content) put together in windows that a request's first part opens, not the clock; the first part after one opens the next.

    The part arms a timer for the window's end in event time, so that parts may come in any order up to `late`. Parts of
    equal time go by seq. A request's state is its open window. It needs the RocksDB state store.
    """
    timed = parts.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy("request_id").transformWithStateInPandas(_Anchored(length_ms), "request_id string, anchor timestamp, content string, n long", "append", "EventTime")


TOTALS = "request_id string, closed_at long, tokens long, n_power long, per_query_kWh double, cpu_kWh double, gpu_kWh double, ram_kWh double, total_kWh double, duration double"
_ENERGY = ("cpu_kWh", "gpu_kWh", "ram_kWh", "total_kWh", "duration")


class _Totals(StatefulProcessor):
    """Sums of a request's events; told once, when the watermark has passed its close."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.power = handle.getListState("power", "seq long, own boolean, " + ", ".join(f"{c} double" for c in _ENERGY))
        self.known = handle.getValueState("known", "closed_at long, tokens_at long, tokens long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        closed_at, tokens_at, tokens = self.known.get() if self.known.exists() else (None, None, 0)
        power = []
        for b in rows:
            for r in b.to_dict("records"):
                if r["type"] == "close" and (closed_at is None or r["seq"] < closed_at):
                    closed_at = int(r["seq"])
                    for t in list(self.handle.listTimers()):
                        self.handle.deleteTimer(t)
                    self.handle.registerTimer(int(r["ms"]) + 1)
                elif r["type"] == "sources" and (tokens_at is None or r["seq"] > tokens_at):
                    tokens_at, tokens = int(r["seq"]), int(r["tokens"] or 0)
                elif str(r["type"]).startswith("power_"):
                    power.append((int(r["seq"]), r["type"] != "power_index", *(float(r[c] or 0) for c in _ENERGY)))
        self.known.update((closed_at, tokens_at, tokens))
        if power:
            self.power.appendList(power)
        yield pd.DataFrame(columns=[c.split()[0] for c in TOTALS.split(", ")]).iloc[:0]

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        closed_at, _, tokens = self.known.get()
        before = [p for p in self.power.get() if p[0] < closed_at]
        sums = [sum(p[i] for p in before) for i in range(2, 2 + len(_ENERGY))]
        own = float(sum(p[2 + _ENERGY.index("total_kWh")] for p in before if p[1]))
        self.power.clear()
        self.known.clear()
        yield pd.DataFrame([(key[0], closed_at, tokens, len(before), own, *map(float, sums))], columns=[c.split()[0] for c in TOTALS.split(", ")])

    def close(self) -> None:
        pass


def totals_at_close(events: DataFrame, late: str = "1 second") -> DataFrame:
    """TOTALS of events (request_id, ts, seq, type, tokens, energies), a row for each request, once, when its close can't be preceded by anything late any more; then the request's state goes. A request that is never closed tells nothing. It needs the RocksDB state store."""
    timed = events.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy("request_id").transformWithStateInPandas(_Totals(), TOTALS, "append", "EventTime")


def dispatch(batch: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> None:
    """Gives each sink its type's events of a micro-batch; other types are left alone. For foreachBatch."""
    batch.persist()
    try:
        for kind, sink in sinks.items():
            sink(batch.where(F.col("type") == kind))
    finally:
        batch.unpersist()


def tracked_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """events (request_id, type, seq, ts, ...) without those that are sent again within `late` of the first."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id", "type", "seq"])


def into(path: str) -> Callable[[DataFrame, int], None]:
    """Writes micro-batches for foreachBatch, a folder each: a batch that is run again after a failure replaces what it wrote before, and adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


ACTIVE_ROW = "key string, request_id string, ts timestamp, seq long, change int, abandoned boolean, active long"


class _Open(StatefulProcessor):
    """A key's open requests and when they are given up. Rows wait until the watermark passes them, so that they count in their own order."""

    def __init__(self, limit_ms: int) -> None:
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, kind int, seq long, request_id string")
        self.opened = handle.getMapState("opened", "request_id string", "ms long")

    def _count(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        held = sorted(self.waiting.get())
        opened = {k[0]: v[0] for k, v in self.opened.iterator()}
        out: list[tuple] = []

        def told(ms: int, seq: int | None, request: str, change: int, abandoned: bool) -> None:
            out.append((key[0], request, pd.Timestamp(ms, unit="ms"), seq, change, abandoned, len(opened)))

        def given_up(upto: int) -> None:
            for request, ms in sorted(opened.items(), key=lambda x: (x[1], x[0])):
                if ms + self.limit <= upto:
                    del opened[request]
                    told(ms + self.limit, None, request, -1, True)

        done = 0
        for ms, kind, seq, request in held:
            if ms > watermark:
                break
            given_up(ms)
            if kind and request not in opened:
                opened[request] = ms
                told(ms, seq, request, 1, False)
            elif not kind and opened.pop(request, None) is not None:
                told(ms, seq, request, -1, False)
            done += 1
        given_up(watermark)
        self.opened.clear()
        for request, ms in opened.items():
            self.opened.updateValue((request,), (ms,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ahead = [ms + self.limit for ms in opened.values()] + [x[0] for x in held[done : done + 1]]
        if held[done:]:
            self.waiting.put(held[done:])
        else:
            self.waiting.clear()
        if ahead:
            self.handle.registerTimer(max(min(ahead), watermark + 1))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in ACTIVE_ROW.split(", ")])
        yield frame.astype({"seq": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.waiting.appendList([(int(m), int(c > 0), int(s), r) for b in rows for m, c, s, r in zip(b["ms"], b["change"], b["seq"], b["request_id"], strict=True)])
        yield from self._count(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._count(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def open_requests(changes: DataFrame, limit_ms: int, late: str = "1 second") -> DataFrame:
    """ACTIVE_ROW of changes (key, request_id, ts, seq, change): how many requests are open after each, as operators.events.open_requests has it.

    A request that isn't ended limit_ms after its start is given up by a timer in event time, which tells the decrement
    that nobody sent. A key's state is its open requests. It needs the RocksDB state store.
    """
    timed = changes.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(_Open(limit_ms), ACTIVE_ROW, "append", "EventTime")


def totals(events: DataFrame) -> DataFrame:
    """Running energy and count of each request, for update mode."""
    return events.groupBy("request_id").agg(F.sum("total_kWh").alias("total_kWh"), F.count("*").alias("n_events"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: each user's events in sessions."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
