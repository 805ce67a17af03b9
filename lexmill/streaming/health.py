"""Health of runs as a stream: starting, ok, stuck and finished, told when it changes, also where no event comes any more.

A run says start, progress and finish. It is starting until its first progress; without one it is stuck `grace` after its
start, and later `silence` after its last progress (strictly: over it). Progress makes a stuck run ok again, and what
comes after a finish is a run of its own. One small state a run is kept until it finishes, with one timer, the moment at
which the run would be stuck. By processing time the clock is the cluster's, so a change is told without a new event; by
event time it is the watermark's, and the result is that of `health_of` over the whole log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GRACE_S, SILENCE_S = 15.0, 30.0
START, PROGRESS, FINISH = "start", "progress", "finish"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunHealth(StatefulProcessor):
    def __init__(self, run: str, grace_ms: int, silence_ms: int, by_event: bool) -> None:
        self.run, self.grace, self.silence, self.by_event = run, grace_ms, silence_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", "health string, deadline long")

    def _rows(self, key: tuple, changes: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        if changes:
            yield pd.DataFrame({self.run: [key[0]] * len(changes), "health": [h for h, _ in changes], "at": pd.to_datetime([t for _, t in changes], unit="ms")})

    def _keep(self, health: str | None, deadline: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if health is None:
            self.state.clear()
            return
        self.state.update((health, deadline))
        if deadline is not None:
            self.handle.registerTimer(deadline)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        health, deadline = self.state.get() if self.state.exists() else (None, None)
        events = pd.concat(list(rows)).sort_values(["ms", "rank"])
        now, changes = timerValues.getCurrentProcessingTimeInMs(), []
        for kind, ms in zip(events["kind"], events["ms"], strict=True):
            at = int(ms) if self.by_event else now
            if deadline is not None and at >= deadline:
                changes.append(("stuck", int(deadline)))
                health, deadline = "stuck", None
            if kind == FINISH:
                changes.append(("finished", at))
                health, deadline = None, None
            elif kind == START and health is None:
                changes.append(("starting", at))
                health, deadline = "starting", at + self.grace
            elif kind == PROGRESS:
                if health != "ok":
                    changes.append(("ok", at))
                health, deadline = "ok", at + self.silence + 1
        self._keep(health, deadline)
        yield from self._rows(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        health, deadline = self.state.get() if self.state.exists() else (None, None)
        if deadline is not None and expiredTimerInfo.getExpiryTimeInMs() >= deadline:
            self.state.update(("stuck", None))
            yield from self._rows(key, [("stuck", int(deadline))])

    def close(self) -> None:
        pass


def _events(log: DataFrame, run: str, kind: str, ts: str) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    rank = F.when(F.col("kind") == START, 0).when(F.col("kind") == PROGRESS, 1).otherwise(2)
    rows = log.select(F.col(run), F.col(kind).alias("kind"), F.unix_millis(at).alias("ms"), at.alias("at"))
    return rows.filter(F.col("kind").isin(START, PROGRESS, FINISH)).withColumn("rank", rank)


def run_health(stream: DataFrame, run: str, kind: str, ts: str, grace_s: float = GRACE_S, silence_s: float = SILENCE_S, late: str | None = None) -> DataFrame:
    """A stream of (run, kind, ts) to the stream of changes (run, health, at). By processing time; with `late`, the watermark's
    delay, by event time. Events of one moment go in the order start, progress, finish; other kinds are left out."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    events = _events(stream, run, kind, ts)
    events = events.withWatermark("at", late) if late else events
    out = T.StructType([stream.schema[run], T.StructField("health", T.StringType()), T.StructField("at", T.TimestampType())])
    processor = RunHealth(run, round(grace_s * 1000), round(silence_s * 1000), late is not None)
    return events.groupBy(run).transformWithStateInPandas(processor, out, "Append", "EventTime" if late else "ProcessingTime")


def health_of(log: DataFrame, run: str, kind: str, ts: str, grace_s: float = GRACE_S, silence_s: float = SILENCE_S) -> DataFrame:
    """The same changes over a whole log, by event time, in window functions. The last event of a run that has not
    finished is followed by its stall."""
    events = _events(log, run, kind, ts)
    order = Window.partitionBy(run).orderBy("ms", "rank")
    # A finish ends a run; what follows it is a part of its own. Only a start that opens its part counts.
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("part", F.coalesce(F.count_if(F.col("kind") == FINISH).over(before), F.lit(0)))
    own = Window.partitionBy(run, "part").orderBy("ms", "rank")
    events = events.withColumn("n", F.row_number().over(own)).filter((F.col("kind") != START) | (F.col("n") == 1))
    due = F.when(F.col("kind") == PROGRESS, F.col("ms") + round(silence_s * 1000) + 1).when(F.col("kind") == START, F.col("ms") + round(grace_s * 1000))
    events = events.withColumn("due", due).withColumns({"next_ms": F.lead("ms").over(own), "was": F.lag("kind").over(own), "was_due": F.lag("due").over(own)})
    again = F.col("was").isNull() | (F.col("was") == START) | (F.col("ms") >= F.col("was_due"))
    change = F.when(F.col("kind") == FINISH, "finished").when(F.col("kind") == START, "starting").when(again, "ok")
    stuck = F.when(F.col("due").isNotNull() & F.coalesce(F.col("next_ms") >= F.col("due"), F.lit(True)), F.struct(F.lit("stuck").alias("health"), F.col("due").alias("t")))
    told = F.filter(F.array(F.when(change.isNotNull(), F.struct(change.alias("health"), F.col("ms").alias("t"))), stuck), lambda x: x.isNotNull())
    return events.select(run, F.explode(told).alias("x")).select(run, "x.health", F.timestamp_millis("x.t").alias("at"))
