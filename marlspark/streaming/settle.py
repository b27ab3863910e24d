"""Waiting for checks to settle: per key, snapshots of its checks until they are settled, absent or timed out.

A snapshot (key, at, state, checks) says whether the checks are pending, have failed or succeeded, and how many there are. The
clock of a key starts with its first snapshot. It ends as failed when a snapshot says so; as success when one says so and
checks were first seen `settle` seconds ago; as success without checks when there are none `grace` seconds after
the start; as timed out at `timeout`. Timers end a key that gets no further snapshot; what comes after the end is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds of the limits, and the least that they can be set to.
TIMEOUT, GRACE, SETTLE, POLL = 1800, 60, 20, 20
LEAST_TIMEOUT, LEAST_GRACE = 30, 5
SUCCESS, NONE, FAILED, LATE = "All reported remote checks passed.", "No remote checks were reported after the grace period.", "Remote checks failed.", "Remote CI timed out."
OUT = "at timestamp, state string, summary string"


def limits(timeout: int = TIMEOUT, grace: int = GRACE, settle: int = SETTLE, poll: int = POLL) -> tuple[int, int, int]:
    """(timeout, grace, settle) in milliseconds."""
    return 1000 * max(timeout, LEAST_TIMEOUT), 1000 * max(grace, poll, LEAST_GRACE), 1000 * max(settle, 0)


class Watch(StatefulProcessor):
    """State: when the clock started and checks were first seen, the last snapshot, and the timer. By the clock of processing
    a snapshot counts when it is handled, by event time at its own `at`."""

    columns = ["key", "at", "state", "summary"]

    def __init__(self, bounds: tuple[int, int, int], by_event_time: bool):
        self.timeout, self.grace, self.settle = bounds
        self.by_event_time = by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "start long, seen long, state string, checks long, due long, over boolean")

    def _ends(self, start: int, seen: int | None, state: str, checks: int) -> tuple[int, str, str]:
        """When the key would end if this snapshot stayed the last, and how."""
        end = start + self.timeout
        if checks and state == "failed":
            return 0, "failed", FAILED
        if checks and state == "success" and seen + self.settle <= end:
            return seen + self.settle, "success", SUCCESS
        if not checks and start + self.grace <= end:
            return start + self.grace, "success", NONE
        return end, "failed", LATE

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        start, seen, state, checks, due, over = tuple(self.at.get()) if self.at.exists() else (None, None, None, 0, None, False)
        out: list[tuple] = []
        if due is not None:
            self.handle.deleteTimer(due)
        now = None if self.by_event_time else timers.getCurrentProcessingTimeInMs()
        for at, state_, checks_ in pd.concat(list(rows)).sort_values("at", kind="stable")[["at", "state", "checks"]].itertuples(index=False, name=None):
            if over:
                break
            now_ = now if now is not None else int(at.timestamp() * 1000)
            if start is not None and (end := self._ends(start, seen, state, checks))[0] <= now_:  # before this snapshot came
                out.append(self._row(key, end))
                over = True
                break
            start = now_ if start is None else start
            state, checks = state_, 0 if pd.isna(checks_) else int(checks_)
            seen = now_ if seen is None and checks else seen
            if (end := self._ends(start, seen, state, checks))[0] <= now_:
                out.append(self._row(key, (now_, *end[1:])))
                over = True
        due = None if over else self._ends(start, seen, state, checks)[0]
        if due is not None:
            self.handle.registerTimer(due)
        self.at.update((start, seen, state, checks, due, over))
        yield pd.DataFrame(out, columns=self.columns)

    def _row(self, key: tuple, end: tuple[int, str, str]) -> tuple:
        return key[0], pd.Timestamp(end[0], unit="ms", tz="UTC"), *end[1:]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        start, seen, state, checks, due, over = tuple(self.at.get())
        out = [] if over else [self._row(key, self._ends(start, seen, state, checks))]
        self.at.update((start, seen, state, checks, None, True))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def settled(snapshots: DataFrame, timeout: int = TIMEOUT, grace: int = GRACE, settle: int = SETTLE, poll: int = POLL, clock: str = "processingTime", delay: str = "1 second") -> DataFrame:
    """snapshots(key, at, state, checks) -> one row per key that has ended: (key, at, state, summary).

    Of a stream by the clock "processingTime", or "eventTime" with a watermark; of a table by the snapshots' own times, as if
    the clock had run on behind the last one. Null checks are none; a null state is pending."""
    bounds = limits(timeout, grace, settle, poll)
    if snapshots.isStreaming:
        rows = snapshots.withColumn("at", F.col("at").cast("timestamp"))
        rows = rows.withWatermark("at", delay) if clock == "eventTime" else rows
        return rows.groupBy("key").transformWithStateInPandas(Watch(bounds, clock == "eventTime"), f"key {snapshots.schema['key'].dataType.simpleString()}, {OUT}", "append", clock)
    late, grace_, settle_ = (F.lit(x).cast("long") for x in bounds)
    w = Window.partitionBy("key").orderBy("at", "_row")
    rows = snapshots.select("key", F.unix_millis(F.col("at").cast("timestamp")).alias("at"), F.coalesce("state", F.lit("pending")).alias("state"), F.coalesce("checks", F.lit(0)).alias("checks")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumns({"start": F.min("at").over(Window.partitionBy("key")), "until": F.lead("at").over(w), "seen": F.min(F.when(F.col("checks") > 0, F.col("at"))).over(w.rowsBetween(Window.unboundedPreceding, 0))})

    def end(at: Column, state: str, summary: str) -> Column:
        return F.struct(F.greatest(at, F.col("at")).alias("at"), F.lit(state).alias("state"), F.lit(summary).alias("summary"))

    over, calm, none = F.col("start") + late, F.col("seen") + settle_, F.col("start") + grace_
    has = F.col("checks") > 0
    found = F.when(has & (F.col("state") == "failed"), end(F.col("at"), "failed", FAILED)).when(has & (F.col("state") == "success") & (calm <= over), end(calm, "success", SUCCESS))
    found = found.when(~has & (none <= over), end(none, "success", NONE)).otherwise(end(over, "failed", LATE))
    ended = rows.withColumn("e", found).filter(F.col("until").isNull() | (F.col("e.at") <= F.col("until")))  # before the next snapshot counts
    first = ended.groupBy("key").agg(F.min_by("e", F.struct("at", "_row")).alias("e"))
    return first.select("key", F.timestamp_millis("e.at").alias("at"), "e.state", "e.summary")
