"""Results of tasks that are started again, overtaken and cancelled: only a result that is still wanted leaves.

Events are (task, ts, kind, generation, value): a task's `start` of a generation, its `result`, or a `cancel` of a
generation (null: of the one at work). In the order of (ts, kind: start, cancel, result; generation), a result leaves if
no event before it has a higher generation, and its generation was neither cancelled nor has brought a result; a
result whose start was never seen counts as its start too. A task's null generation in a start or result, and an
event without task, ts or a known kind, is no event.

The stream keeps for each task the newest generation and whether it is closed: 9 bytes that stay, so a result that is a
day late is still known to be stale. With `forget`, a task without an event for that long is dropped by a timer on event
time; events older than the watermark are then dropped before they are looked at, and `forget` must be longer.
Micro-batches may cut the events anywhere, as long as a task's events don't cross: then stream and batch agree.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "task long, ts timestamp, kind string, generation long, value string"
RESULTS = "task long, ts timestamp, generation long, value string"
ORDER = ("start", "cancel", "result")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), kind).cast("int")


def known(events: DataFrame) -> DataFrame:
    """The events that count."""
    whole = F.col("task").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*ORDER)
    return events.where(whole & ((F.col("kind") == "cancel") | F.col("generation").isNotNull()))


def before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with the highest value among a task's events before each: inside its slice of time by a window, from the slices before by their own highest, so that one task's events are not one sort."""
    at = Window.partitionBy("task", "slice").orderBy("ts", rank(F.col("kind")), F.asc_nulls_first("generation")).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("task", "slice").agg(F.max(value).alias("top"))
    earlier = Window.partitionBy("task").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("task", "slice", F.max("top").over(earlier).alias("carried"))
    return rows.withColumn("inside", F.max(value).over(at)).join(tops, ["task", "slice"]).withColumn(name, F.greatest("inside", "carried")).drop("inside", "carried")


def wanted(events: DataFrame, slices: str = "hour") -> DataFrame:
    """RESULTS of a finished table of events."""
    rows = known(events).select("task", "ts", "kind", "generation", "value", F.date_trunc(slices, "ts").alias("slice"))
    rows = before(rows, "generation", "newest")
    rows = rows.withColumn("own", F.coalesce("generation", "newest"))  # what a cancel of the one at work cancels
    fresh = F.col("own") >= F.coalesce("newest", "own")
    rows = before(rows.withColumn("ends", F.when((F.col("kind") == "cancel") | ((F.col("kind") == "result") & fresh), F.col("own"))), "ends", "ended")
    still = (F.col("kind") == "result") & fresh & (F.coalesce("ended", F.col("own") - 1) < F.col("own"))
    return rows.where(still).select("task", "ts", "generation", "value")


class Wanted(StatefulProcessor):
    """The newest generation of a task, and whether it is closed."""

    def __init__(self, forget_ms: int | None = None):
        self.forget = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "generation long, closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()  # each call goes to the state's server: null if there is none
        newest, closed = held if held else (None, False)
        last = None
        for row in sorted(rows, key=lambda r: (r.ts, ORDER.index(r.kind), r.generation is not None, r.generation or 0)):
            last, own = row.ts, row.generation if row.generation is not None else newest
            if own is None or newest is not None and own < newest:
                continue
            if newest is None or own > newest:
                newest, closed = own, False
            if row.kind == "result" and not closed:
                yield Row(task=key[0], ts=row.ts, generation=own, value=row.value)
            closed |= row.kind != "start"
        if newest is not None and (newest, closed) != (tuple(held) if held else None):
            self.state.update((newest, closed))
        if self.forget is not None and last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.forget)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def wanted_stream(events: DataFrame, late: str = "1 hour", forget_ms: int | None = None) -> DataFrame:
    """RESULTS of a stream of events, in append mode. Sets the state store that this needs in the session."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = known(events)
    if forget_ms is not None:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("task").transformWithState(Wanted(forget_ms), RESULTS, "Append", "None" if forget_ms is None else "EventTime")
