"""Stream forms of the ordered operators: sessions, sequential acceptance, rolling features.

Events carry (video_id, at, value); state is kept per entity and is bounded: a session window,
one time, the last few values, or the last accepted vector: bounded for each entity. Without idle_ms the
number of entities in the state is not; with it, entities leave the state after so long without events, and such a
stream never ends by itself, so runs to the end of what is there go without. Within a micro-batch events are taken in order of
time; one that comes in a later micro-batch than its successors is taken when it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequential import cosine


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Clusters of events at most gap apart, emitted once the watermark has passed their end."""
    return (
        events.withWatermark("at", late)
        .groupBy("video_id", F.session_window("at", gap))
        .agg(F.min("at").alias("start"), F.max("at").alias("last"), F.count("*").alias("n"), F.max("value").alias("peak"))
        .drop("session_window")
    )


def spaced(events: DataFrame, gap_seconds: float, idle_ms: int | None = None) -> DataFrame:
    """Events at least gap after the last one kept of their entity, in the order of each micro-batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for b in batches for t in b["t"].tolist()):
            if last is None or t - last >= gap_seconds:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if kept:
            yield pd.DataFrame({"video_id": [key[0]] * len(kept), "t": kept})

    timed = events.withColumn("t", F.unix_micros("at") / F.lit(1e6)).select("video_id", "t")
    return timed.groupBy("video_id").applyInPandasWithState(step, "video_id long, t double", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def rolling(events: DataFrame, rows: int, idle_ms: int | None = None) -> DataFrame:
    """Difference to the value before and mean and maximum of the last `rows` values: the frame loop's bounded state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        out = []
        for t, v in sorted((t, v) for b in batches for t, v in b[["t", "value"]].itertuples(index=False)):
            change = v - held[-1] if held else 0.0
            held = [*held, v][-rows:]
            out.append((key[0], t, change, sum(held) / len(held), max(held)))
        state.update((held,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["video_id", "t", "change", "rolling_mean", "rolling_max"])

    timed = events.withColumn("t", F.unix_micros("at") / F.lit(1e6)).select("video_id", "t", "value")
    return timed.groupBy("video_id").applyInPandasWithState(step, "video_id long, t double, change double, rolling_mean double, rolling_max double", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def accepted(events: DataFrame, threshold: float, form: str = "first", rapid: float = 0.0, rapid_window: float = 0.0, similarity=cosine, idle_ms: int | None = None) -> DataFrame:
    """Decisions of sequential deduplication as a stream: (video_id, t, action, instead_of, similarity), a row per event.

    Events carry (video_id, at, vector and, for "cleaner", penalty); the state is the last accepted one. Below
    threshold an event is accepted ("keep"). At or above it, form "first" drops it (or accepts it below
    `rapid` within rapid_window seconds of the last one), "latest" puts it in the last one's place ("replace"), and "cleaner" does
    so if its penalty is strictly less. Null vectors are kept and never compared with. The kept set is that of all keeps
    without those that a later replace names in instead_of.
    """
    if form not in ("first", "latest", "cleaner"):
        raise ValueError(form)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, at, cost = state.get if state.exists else (None, 0.0, 0.0)
        last = None if last is None else np.asarray(last, np.float64)
        rows = sorted(((t, v, p) for b in batches for t, v, p in b[["t", "vector", "penalty"]].itertuples(index=False)), key=lambda r: r[0])
        out = []
        for t, v, p in rows:
            if v is None:
                out.append((key[0], t, "keep", None, None))
                continue
            v = np.asarray(v, np.float64)
            s = None if last is None else float(similarity(last, v))
            limit = max(threshold, rapid) if form == "first" and last is not None and t - at < rapid_window else threshold
            if s is None or s < limit:
                action = "keep"
            elif form == "latest" or form == "cleaner" and p < cost:
                action = "replace"
            else:
                action = "drop"
            out.append((key[0], t, action, at if action == "replace" else None, s))
            if action != "drop":
                last, at, cost = v, t, float(p or 0.0)
        if last is not None:
            state.update((last.tolist(), at, cost))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["video_id", "t", "action", "instead_of", "similarity"]).astype({"instead_of": "float64", "similarity": "float64"})

    penalty = F.col("penalty") if "penalty" in events.columns else F.lit(0.0)
    timed = events.select("video_id", (F.unix_micros("at") / F.lit(1e6)).alias("t"), F.col("vector").cast("array<double>").alias("vector"), penalty.cast("double").alias("penalty"))
    shape = "video_id long, t double, action string, instead_of double, similarity double"
    return timed.groupBy("video_id").applyInPandasWithState(step, shape, "vector array<double>, at double, cost double", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there now through the stream into a table at path, which is returned."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
