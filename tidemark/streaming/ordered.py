"""Ordered folds over streams whose events arrive out of order, on the second state interface.

Events carry (video_id, at, value). An entity holds its events back in a list state until the watermark has passed
them; an event-time timer then releases them in order of (time, value) to the fold, whose own value state survives from release to
release. So the result does not depend on how events are dealt over micro-batches, as long as none is later than
the watermark allows; those that are, Spark leaves out. Held events of an entity are those of one span of `late`. Events with a null
time are left out; a null value reaches the fold as None.

The sessions of such streams need the RocksDB state store: `run_ordered()` sets it for its run.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .sessions import run_to_end

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A fold takes (state or None, microseconds, value) and gives (state, output row or None).
Fold = Callable[[tuple | None, int, float | None], tuple[tuple, tuple | None]]


class Release(StatefulProcessor):
    """Holds events until their time has passed, then folds them in order."""

    def __init__(self, fold: Fold, state: str, columns: list[str], idle_ms: int | None):
        self._fold, self._state, self._columns, self._idle_ms = fold, state, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", "at long, value double")
        self._last = handle.getValueState("last", self._state, self._idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [_row(at, v) for batch in rows for at, v in zip(batch["micros"], batch["value"], strict=True)]
        if new:
            self._held.appendList(new)
            self._wake(min(at for at, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((_row(at, v) for at, v in self._held.get()), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        due = [r for r in held if r[0] <= passed]
        rest = held[len(due) :]
        if not due:
            if rest:
                self._wake(rest[0][0])
            return
        if rest:
            self._held.put(rest)
            self._wake(rest[0][0])
        else:
            self._held.clear()
        state, out = (tuple(self._last.get()) if self._last.exists() else None), []
        for at, value in due:
            state, row = self._fold(state, at, value)
            if row is not None:
                out.append((key[0], *row))
        self._last.update(state)
        if out:
            yield pd.DataFrame(out, columns=self._columns)

    def close(self) -> None:
        pass

    def _wake(self, micros: int) -> None:
        # the first millisecond not before the event
        self._handle.registerTimer(-(-micros // 1000))


def _row(at, value) -> tuple[int, float | None]:
    return int(at), None if value is None or math.isnan(value) else float(value)


def in_order(events: DataFrame, late: str, fold: Fold, state: str, out: str, idle_ms: int | None = None) -> DataFrame:
    """What the fold gives over the events of each entity, in order of time, once the watermark has passed them.

    state and out are schemas, out without the entity, which comes first. With idle_ms the fold's state is dropped
    after so long without a release.
    """
    shape = f"video_id long, {out}"
    columns = ["video_id", *(c.strip().split(" ")[0] for c in out.split(","))]
    timed = events.where(F.col("at").isNotNull()).select(F.col("video_id").cast("long").alias("video_id"), "at", F.unix_micros("at").alias("micros"), F.col("value").cast("double").alias("value"))
    return timed.withWatermark("at", late).groupBy("video_id").transformWithStateInPandas(Release(fold, state, columns, idle_ms), shape, "append", "eventtime")


def spaced_in_order(events: DataFrame, gap_seconds: float, late: str, idle_ms: int | None = None) -> DataFrame:
    """(video_id, t) of events at least gap after the last one kept."""
    gap = round(gap_seconds * 1_000_000)

    def step(state, at, value):
        if state is None or at - state[0] >= gap:
            return (at,), (at / 1e6,)
        return state, None

    return in_order(events, late, step, "last long", "t double", idle_ms)


def sessions_in_order(events: DataFrame, gap_seconds: float, late: str, idle_ms: int | None = None) -> DataFrame:
    """(video_id, start, end, n, peak) of runs of events less than gap apart, given when the run after them begins."""
    gap = round(gap_seconds * 1_000_000)

    def step(state, at, value):
        if state is None:
            return (at, at, 1, value), None
        start, end, n, peak = state
        if at - end < gap:
            best = max((v for v in (peak, value) if v is not None), default=None)
            return (start, at, n + 1, best), None
        return (at, at, 1, value), (start / 1e6, end / 1e6, n, peak)

    return in_order(events, late, step, "start long, end long, n long, peak double", "start double, end double, n long, peak double", idle_ms)


def run_ordered(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """run_to_end() on the state store that the second interface needs; the session's own setting comes back afterwards."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return run_to_end(stream, path, checkpoint)
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
