"""Which runs are alive, as a stream tells it: timers in event time reap uploads that wait too long and runs that nobody looks at."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from . import uploads

TOLD = "run string, state string, at_ms long"
PENDING_MS, GRACE_MS = 120_000, 300_000
#: Buckets that runs are dealt over by their names; each is one state.
BUCKETS = 1024
#: A run that is not known: phase, subscribers, when it was last heard of, what was told, when it is gone.
NEW = ("pending", 0, -1, "", None)


class Liveness(StatefulProcessor):
    """Of the runs of a bucket: the phase of each, who looks at it, when it was last heard of, what was last told, and when it is gone.

    A bucket is one state with one timer, that of the run which is gone first, so that a micro-batch reads, writes and
    sends once for a bucket, not once for each run or change.
    """

    def __init__(self, pending_ms: int, grace_ms: int):
        self.pending_ms, self.grace_ms = pending_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "runs array<string>, phases array<string>, subscribers array<long>, seen_ms array<long>, told array<string>, gone_ms array<long>")

    def _wait(self, phase: str, subscribers: int) -> int | None:
        if phase in ("finished", "cleaning"):
            return None
        waits = ([self.pending_ms] if phase == "pending" else []) + ([self.grace_ms] if subscribers == 0 else [])
        return min(waits) if waits else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, told = self._held(), []
        timer = self._first(held)
        frame = pd.concat(list(rows)).sort_values("ms", kind="stable")
        # A silence that is too long counts by the beats' own times, whether its end comes before or after the timer goes off.
        for run, ms, phase, subscribers in zip(*(frame[c].tolist() for c in ("run", "ms", "phase", "subscribers")), strict=True):
            before, _, seen, state, gone = held.get(run, NEW)
            if ms < seen:
                continue
            if gone is not None and ms >= gone:
                told.append((run, self._gone(before), gone))
                state = ""
            now = "finished" if phase == "finished" else "live"
            if now != state:
                told.append((run, now, ms))
            wait = self._wait(phase, subscribers)
            held[run] = (phase, subscribers, ms, now, None if wait is None else ms + wait + 1)
        yield from self._settled(held, told, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(self._held(), [], None, timerValues.getCurrentWatermarkInMs())

    def _held(self) -> dict[str, tuple]:
        columns = self.runs.get() or ((),) * 6
        return {run: rest for run, *rest in zip(*columns, strict=True)}

    def _first(self, held: dict[str, tuple]) -> int | None:
        return min((gone for *_, gone in held.values() if gone is not None), default=None)

    def _gone(self, phase: str) -> str:
        return "expired" if phase == "pending" else "abandoned"

    def _settled(self, held: dict[str, tuple], told: list[tuple], timer: int | None, watermark: int) -> Iterator[pd.DataFrame]:
        for run, (phase, *_, gone) in list(held.items()):
            if gone is not None and gone <= watermark:
                told.append((run, self._gone(phase), gone))
                del held[run]  # a run that is gone takes no room; when it is heard of again it starts anew
        first = self._first(held)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        if held:
            self.runs.update((list(held), *map(list, zip(*held.values(), strict=True))))
        else:
            self.runs.clear()
        if told:
            columns = dict(zip(("run", "state", "at_ms"), zip(*told, strict=True), strict=True))
            yield pd.DataFrame({c: pd.Series(v, dtype="int64" if c == "at_ms" else object) for c, v in columns.items()})

    def close(self) -> None:
        pass


def changes(beats: DataFrame, late: str = "0 seconds", pending_ms: int = PENDING_MS, grace_ms: int = GRACE_MS, buckets: int = BUCKETS) -> DataFrame:
    """run, state, at_ms: each change of a run's state (live, finished, expired, abandoned), from a stream of run, ts, phase, subscribers.

    Pending runs expire after their time, others that nobody looks at are abandoned after a time of grace; cleaning and
    finished ones are never reaped. Times are those of the beats: a timer goes off when all that is later than the
    watermark allows has passed it. Beats older than the last one heard change nothing; null runs are none. A bucket's
    runs and its beats of a micro-batch are held by one task: take more buckets for tens of millions of runs. Their
    number is fixed once a checkpoint exists.
    """
    uploads.with_store(beats.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    typed = beats.where("run IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    typed = typed.select("ts", F.col("run").cast("string").alias("run"), F.unix_millis("ts").alias("ms"), F.coalesce("phase", F.lit("pending")).alias("phase"), F.coalesce("subscribers", F.lit(0)).cast("long").alias("subscribers"))
    typed = typed.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)))
    return typed.groupBy("bucket").transformWithStateInPandas(Liveness(pending_ms, grace_ms), TOLD, "Append", "EventTime")


def latest(told: DataFrame) -> DataFrame:
    """run, state of each run by the last change told; of changes at one time the last of live, finished, expired and abandoned counts."""
    rank = F.when(F.col("state") == "live", 0).otherwise(1)
    return told.groupBy("run").agg(F.max_by("state", F.struct("at_ms", rank)).alias("state"))
