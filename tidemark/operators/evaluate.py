"""Evaluation: confusion counts, sweeps, ranking quality, tolerance matching."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold
from .windows import PART


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, *keys: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tp, fp, fn, tn by keys: one pass of conditional sums."""
    count = lambda y, p: F.sum(((F.col(label) == y) & (F.col(prediction) == p)).cast("long"))
    return df.groupBy(*keys).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))


def with_scores(df: DataFrame, digits: int = 6) -> DataFrame:
    """df (tp, fp, fn and perhaps tn) with precision, recall, f1 and accuracy."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    if "tn" in df.columns:
        out["accuracy"] = ratio(tp + F.col("tn"), tp + fp + fn + F.col("tn"))
    return df.withColumns({k: F.round(v, digits) for k, v in out.items()})


def threshold_sweep(df: DataFrame, score: str, thresholds: list[float], label: str = "label") -> DataFrame:
    """Confusion and scores at each threshold.

    Rows are first counted by (label, thresholds passed), so each is expanded to nothing: the counts
    per threshold are sums over a table of len(thresholds) + 1 rows per label.
    """
    passed = sum(((F.col(score) >= t).cast("int") for t in thresholds), F.lit(0))
    counts = df.groupBy(F.col(label).alias("y"), passed.alias("k")).agg(F.count("*").alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i + 1).alias("need")) for i, t in enumerate(sorted(thresholds))]))
    each = counts.select("y", "k", "n", levels.alias("l")).select("y", "n", "l.threshold", (F.col("k") >= F.col("l.need")).cast("int").alias("p"))
    part = lambda y, p: F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col("n")).otherwise(0))
    return with_scores(each.groupBy("threshold").agg(part(1, 1).alias("tp"), part(0, 1).alias("fp"), part(1, 0).alias("fn"), part(0, 0).alias("tn")))


def optimal_threshold(sweep: DataFrame, least_recall: float) -> DataFrame:
    """Of thresholds with enough recall the one of greatest f1, the lowest of equals; without any, of all."""
    return sweep.orderBy(F.desc(F.col("recall") >= least_recall), F.desc("f1"), "threshold").limit(1)


def _stretch(score: Column) -> Column:
    """A whole number from -4096 to 4096 that never falls as the score grows: each step rounds a monotone function."""
    size = F.floor((1 - 1 / (1 + F.abs(score))) * 4096)
    return F.when(score < 0, -size - 1).otherwise(size)


def roc_auc(df: DataFrame, score: str, label: str = "label", *keys: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks, from one row per (key, score value).

    Ranks are counted within stretches of the score's range and lifted by the rows of the stretches before, of which
    there are some thousands at most, so no task sorts all values.
    """
    grouped = df.groupBy(*keys, _stretch(F.col(score)).alias("_at"), score).agg(F.sum(label).cast("double").alias("_pos"), F.count("*").cast("double").alias("_all"))
    before = lambda w: F.coalesce(F.sum("_all").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inner = grouped.withColumn("_in", before(Window.partitionBy(*keys, "_at").orderBy(score)) + (F.col("_all") + 1) / 2)
    # per stretch: sums that do not know yet how many rows lie before it
    parts = inner.groupBy(*keys, "_at").agg(F.sum(F.col("_in") * F.col("_pos")).alias("_r"), F.sum("_pos").alias("_p"), F.sum("_all").alias("_all"))
    lifted = parts.withColumn("_r", F.col("_r") + F.col("_p") * before(Window.partitionBy(*keys).orderBy("_at")))
    sums = lifted.groupBy(*keys).agg(F.sum("_r").alias("_r"), F.sum("_p").alias("_p"), F.sum("_all").alias("_n"))
    return sums.select(*keys, F.when((F.col("_p") > 0) & (F.col("_n") > F.col("_p")), (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * (F.col("_n") - F.col("_p")))).alias("auc"))


def _matches(times: np.ndarray, wanted: np.ndarray, tolerance: float) -> int:
    """How many of wanted, in order, find a free one of times (the first in their order) within tolerance."""
    order = np.argsort(times, kind="stable")
    by_time = times[order]
    low = np.searchsorted(by_time, np.nextafter(wanted - tolerance, -np.inf)).tolist()
    high = np.searchsorted(by_time, np.nextafter(wanted + tolerance, np.inf), "right").tolist()
    # the next free place at or after each place, with shortcuts over taken ones
    free = list(range(len(times) + 1))
    listed, place, hits = by_time.tolist(), order.tolist(), 0

    def next_free(k: int) -> int:
        while free[k] != k:
            free[k] = k = free[free[k]]
        return k

    for x, a, b in zip(wanted.tolist(), low, high, strict=True):
        best, k = -1, next_free(a)
        while k < b:
            if abs(listed[k] - x) <= tolerance and (best < 0 or place[k] < place[best]):
                best = k
            k = next_free(k + 1)
        if best >= 0:
            free[best] = best + 1
            hits += 1
    return hits


def tolerance_match(predicted: DataFrame, truth: DataFrame, tolerance: float, time: str = "t", part: str = PART) -> DataFrame:
    """(entity, tp, fp, fn): each prediction in order takes the first free truth within tolerance.

    Order is that of the column ord. The choice depends on what earlier predictions took, so each
    entity is a fold; both sides meet in one exchange. Entities on either side appear.
    """

    def match(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        true = values["side"] == 1
        tp = _matches(values[time][true], values[time][~true], tolerance)
        return {"tp": np.array([tp]), "fp": np.array([int((~true).sum()) - tp]), "fn": np.array([int(true.sum()) - tp])}

    sided = lambda df, k: df.select(part, F.col(time).cast("double").alias(time), "ord", F.lit(k).alias("side"))
    kind = predicted.schema[part].dataType.simpleString()
    return fold(sided(predicted, 0).unionByName(sided(truth, 1)), part, ["side", "ord"], match, f"{part} {kind}, tp long, fp long, fn long")
