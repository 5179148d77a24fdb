"""Gap clustering: islands, peak suppression, bursts, minimum spacing.

A cluster goes on while a row is within `gap` of the row before it (single linkage, gap included).
Two window functions over one sort find clusters; picking a row per cluster reuses the partitioning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold
from .windows import ORDER, PART, ordered


def islands(df: DataFrame, gap: float, time: str = "t", part: str = PART, out: str = "cluster") -> DataFrame:
    """df with the number of each row's cluster within its entity, from 1."""
    w = ordered(part, time)
    starts = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("_new", starts).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def suppress(df: DataFrame, score: str, threshold: float, gap: float, time: str = "t", part: str = PART, tie: str = ORDER) -> DataFrame:
    """df with smoothed: 1 on the best row of each cluster of rows at or above threshold (the earliest of equals), else 0.

    Never null: entities without a positive row get zeros.
    """
    w = ordered(part, time, tie)
    hit = F.col(score) >= threshold
    last_hit = F.last(F.when(hit, F.col(time)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = (hit & (last_hit.isNull() | (F.col(time) - last_hit > gap))).cast("int")
    marked = df.withColumn("_hit", hit).withColumn("_new", starts).withColumn("_c", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(part, "_hit", "_c").orderBy(F.desc(score), time, tie)
    return marked.withColumn("smoothed", (F.col("_hit") & (F.row_number().over(best) == 1)).cast("int")).drop("_hit", "_new", "_c")


def bursts(df: DataFrame, gap: float, time: str = "t", part: str = PART) -> DataFrame:
    """(entity, cluster, start, end, n, timestamps) of the distinct times of df; equal times count once."""
    times = F.sort_array(F.collect_set(time)).alias("timestamps")
    found = islands(df.select(part, time), gap, time, part).groupBy(part, "cluster").agg(F.min(time).alias("start"), F.max(time).alias("end"), times)
    return found.select(part, "cluster", "start", "end", F.size("timestamps").cast("long").alias("n"), "timestamps")


def burst_representative(df: DataFrame, gap: float, score: str, able: Column | bool = True, time: str = "t", part: str = PART) -> DataFrame:
    """(entity, cluster, n, time, score): the row of least score among each burst's able rows (earliest of equals); without any, its middle time.

    Bursts, their times and their best row are one aggregate over the clusters' own partitioning.
    """
    able = F.lit(able) if isinstance(able, bool) else able
    best = F.min(F.when(able, F.struct(F.col(score).alias("s"), F.col(ORDER).alias("i"), F.col(time).alias("t")))).alias("_b")
    found = islands(df, gap, time, part).groupBy(part, "cluster").agg(F.sort_array(F.collect_set(time)).alias("_ts"), best)
    middle = F.get("_ts", F.floor(F.size("_ts") / 2).cast("int"))
    return found.select(part, "cluster", F.size("_ts").cast("long").alias("n"), F.coalesce("_b.t", middle).alias(time), F.col("_b.s").alias(score))


def last_of_cluster(df: DataFrame, gap: int, order: str = ORDER, part: str = PART) -> DataFrame:
    """The last row number of each cluster in row numbers."""
    return islands(df, gap, order, part).groupBy(part, "cluster").agg(F.max(order).alias(order), F.count("*").alias("n"))


def spaced_out(times: np.ndarray, gap: float) -> np.ndarray:
    """Indices of sorted times kept greedily: the first, then each at least gap after the last kept one."""
    kept, at, n = [], 0, len(times)
    while at < n:
        kept.append(at)
        last = times[at]
        nxt = int(np.searchsorted(times, last + gap))
        # the sum is rounded, the difference decides
        while nxt > at + 1 and times[nxt - 1] - last >= gap:
            nxt -= 1
        nxt = max(nxt, at + 1)
        while nxt < n and times[nxt] - last < gap:
            nxt += 1
        at = nxt
    return np.array(kept, np.int64)


def min_gap(df: DataFrame, gap: float, time: str = "t", part: str = PART) -> DataFrame:
    """Times kept greedily: the first, then each at least gap after the last kept one.

    The choice depends on the last kept time, so it is a fold over an entity's sorted times; it
    jumps from one kept time to the next by bisection. Null times are left out.
    """

    def keep(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        times = np.unique(values[time])
        return {time: times[spaced_out(times, gap)]}

    kind = {f.name: f.dataType.simpleString() for f in df.select(part, time).schema}
    return fold(df.select(part, F.col(time).cast("double").alias(time)).where(F.col(time).isNotNull()), part, [time], keep, f"{part} {kind[part]}, {time} double")


def with_end_row(df: DataFrame, durations: DataFrame, time: str = "t", part: str = PART) -> DataFrame:
    """(entity, time, synthetic): df's times and one further row at each entity's duration."""
    return df.select(part, time, F.lit(0).alias("synthetic")).unionByName(durations.select(part, F.col("duration").alias(time), F.lit(1).alias("synthetic")))
