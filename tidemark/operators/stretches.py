"""The operators of gap clusters, spacing and matching for entities too long for one task.

An entity's time is cut into stretches of a given width, each of which is worked on alone; one summary row per stretch says
what its neighbours must know, and only summaries meet per entity. Results equal those of the operators of the
same names in cluster and evaluate. Rows without a time or an entity are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate
from .cluster import spaced_out
from .fold import fold
from .windows import ORDER, PART


def _stretch(time: str, width: float) -> Column:
    return F.floor(F.col(time) / F.lit(float(width)))


def islands(df: DataFrame, gap: float, width: float, time: str = "t", part: str = PART, out: str = "cluster") -> DataFrame:
    """df with the number of each row's cluster within its entity, from 1.

    A stretch numbers its own clusters; its first and last time and its number of clusters are enough to tell whether
    it goes on with the last cluster of the stretch before, and how many came earlier.
    """
    cut = df.where(F.col(time).isNotNull() & F.col(part).isNotNull()).withColumn("_s", _stretch(time, width))
    own = Window.partitionBy(part, "_s").orderBy(time)
    starts = F.coalesce((F.col(time) - F.lag(time).over(own) > gap).cast("int"), F.lit(0))
    inner = cut.withColumn("_new", starts).withColumn("_in", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    summary = inner.groupBy(part, "_s").agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.max("_in").alias("_more"))
    order = Window.partitionBy(part).orderBy("_s")
    fresh = F.coalesce((F.col("_first") - F.lag("_last").over(order) > gap).cast("int"), F.lit(1))
    before = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_more").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = summary.withColumn("_fresh", fresh).select(part, "_s", before.alias("_base"))
    return inner.join(base, [part, "_s"]).withColumn(out, F.col("_in") + F.col("_base")).drop("_s", "_in", "_base")


def suppress(df: DataFrame, score: str, threshold: float, gap: float, width: float, time: str = "t", part: str = PART, tie: str = ORDER) -> DataFrame:
    """df with smoothed: 1 on the best row of each cluster of rows at or above threshold (the earliest of equals), else 0.

    The best row of a cluster is an aggregate that combines on the map side; rows learn of it by (entity, tie), which names a row.
    """
    hits = islands(df.where(F.col(score) >= threshold).select(part, time, tie, score), gap, width, time, part)
    best = hits.groupBy(part, "cluster").agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(time)).alias("t"), (-F.col(tie)).alias("i"))).alias("b"))
    marks = best.select(part, (-F.col("b.i")).alias(tie), F.lit(1).alias("_best"))
    return df.join(marks, [part, tie], "left").select(*df.columns, F.coalesce("_best", F.lit(0)).alias("smoothed"))


def bursts(df: DataFrame, gap: float, width: float, time: str = "t", part: str = PART) -> DataFrame:
    """(entity, cluster, start, end, n, timestamps) of the distinct times of df."""
    times = F.sort_array(F.collect_set(time)).alias("timestamps")
    found = islands(df.select(part, time), gap, width, time, part).groupBy(part, "cluster").agg(F.min(time).alias("start"), F.max(time).alias("end"), times)
    return found.select(part, "cluster", "start", "end", F.size("timestamps").cast("long").alias("n"), "timestamps")


def _next_kept(times: np.ndarray, gap: float) -> np.ndarray:
    """For each of sorted times the index of the first that is at least gap later, len(times) without any."""
    found = np.searchsorted(times, times + gap)
    # the sum is rounded, the difference decides
    while True:
        early = (found > np.arange(len(times)) + 1) & (times[np.maximum(found - 1, 0)] - times >= gap)
        late = (found < len(times)) & (times[np.minimum(found, len(times) - 1)] - times < gap)
        if not (early.any() or late.any()):
            return np.maximum(found, np.arange(len(times)) + 1)
        found = found - early + late


def _last_kept(times: np.ndarray, gap: float) -> np.ndarray:
    """For each of sorted times the last index kept if it is kept itself: pointers to the next one, doubled until they stand still."""
    own = np.arange(len(times))
    step = _next_kept(times, gap)
    at = np.where(step < len(times), step, own)
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def _keyed(df: DataFrame, part: str, time: str, width: float) -> DataFrame:
    return df.where(F.col(time).isNotNull() & F.col(part).isNotNull()).select(F.concat(F.col(part).cast("string"), F.lit("@"), _stretch(time, width)).alias("_key"), part, F.col(time).cast("double").alias(time), _stretch(time, width).alias("_s"))


def min_gap(df: DataFrame, gap: float, width: float, time: str = "t", part: str = PART) -> DataFrame:
    """Times kept greedily: the first, then each at least gap after the last kept one.

    Whatever was kept before, a stretch is entered at one of its times within the first gap or at the one behind them. A first pass
    tells for each of these where the walk leaves the stretch, by doubled pointers; a second one goes from stretch to
    stretch over these tables; a third one walks each stretch from its entry.
    """
    if not width > gap > 0:
        raise ValueError("stretches are wider than the gap, and the gap is positive")
    kinds = {f.name: f.dataType.simpleString() for f in df.select(part).schema}
    rows = _keyed(df, part, time, width)

    def leave(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        times = np.unique(values[time])
        start = values["_s"][0] * width
        n = int(np.count_nonzero(times - start < gap * (1 + 1e-9) + abs(start) * 1e-12)) + 1  # the border itself is rounded
        last = _last_kept(times, gap)[:n]
        return {part: np.repeat(values[part][:1], len(last)), "_s": np.repeat(values["_s"][:1], len(last)), "_in": times[:n], "_out": times[last]}

    doors = fold(rows, "_key", [time], leave, f"_key string, {part} {kinds[part]}, _s long, _in double, _out double")

    def pass_through(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        entered, last = [], -np.inf
        stretches, starts = np.unique(values["_s"], return_index=True)
        ends = [*starts[1:].tolist(), len(values["_s"])]
        for a, b in zip(starts.tolist(), ends, strict=True):
            able = np.flatnonzero(values["_in"][a:b] - last >= gap)
            if len(able):
                entered.append(a + int(able[0]))
                last = values["_out"][entered[-1]]
        at = np.array(entered, np.int64)
        return {"_key": values["_key"][at], "_in": values["_in"][at]}

    entries = fold(doors, part, ["_s", "_in"], pass_through, f"{part} {kinds[part]}, _key string, _in double")

    def walk(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        entry = values[time][values["_entry"] == 1]
        if not len(entry):
            return {part: values[part][:0], time: values[time][:0]}
        times = np.unique(values[time])
        kept = times[times >= entry[0]]
        kept = kept[spaced_out(kept, gap)]
        return {part: np.repeat(values[part][:1], len(kept)), time: kept}

    both = rows.select("_key", part, time, F.lit(0).alias("_entry")).unionByName(entries.select("_key", part, F.col("_in").alias(time), F.lit(1).alias("_entry")))
    return fold(both, "_key", [time], walk, f"_key string, {part} {kinds[part]}, {time} double").select(part, time)


def tolerance_match(predicted: DataFrame, truth: DataFrame, tolerance: float, width: float, time: str = "t", part: str = PART) -> DataFrame:
    """(entity, tp, fp, fn): each prediction in order takes the first free truth within tolerance.

    Where no time of either side lies within the tolerance of the next, nothing on one side of the cut can match
    anything on the other: the clusters of all times are independent parts, matched apart and summed.
    """
    sided = lambda df, k: df.select(part, F.col(time).cast("double").alias(time), "ord", F.lit(k).alias("side"))
    parts = islands(sided(predicted, 0).unionByName(sided(truth, 1)), tolerance, width, time, part)
    keyed = parts.withColumn("_key", F.concat(F.col(part).cast("string"), F.lit("@"), F.col("cluster"))).drop("cluster")

    def match(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        true = values["side"] == 1
        tp = evaluate._matches(values[time][true], values[time][~true], tolerance)
        return {part: values[part][:1], "tp": np.array([tp]), "fp": np.array([int((~true).sum()) - tp]), "fn": np.array([int(true.sum()) - tp])}

    kind = predicted.schema[part].dataType.simpleString()
    counted = fold(keyed, "_key", ["side", "ord"], match, f"_key string, {part} {kind}, tp long, fp long, fn long")
    return counted.groupBy(part).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
