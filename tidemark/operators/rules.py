"""Rule-based classification and distribution summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QualityLimits:
    sharpness: float = 100
    dark: float = 50
    bright: float = 220
    teacher: float = 15
    contrast: float = 30


def quality(df: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """df (sharpness, brightness, teacher, contrast) with score, class and issues; bounds themselves pass."""
    blurry, dark, bright = F.col("sharpness") < limits.sharpness, F.col("brightness") < limits.dark, F.col("brightness") > limits.bright
    blocked, flat = F.col("teacher") > limits.teacher, F.col("contrast") < limits.contrast
    off = lambda bad, n: F.when(bad, n).otherwise(0)
    score = 100 - off(blurry, 30) - off(dark | bright, 20) - off(blocked, 25) - off(flat, 15)
    issues = F.array_compact(F.array(F.when(blurry, "blurry"), F.when(dark, "too dark").when(bright, "too bright"), F.when(blocked, "teacher blocking"), F.when(flat, "low contrast")))
    named = F.when(F.col("score") >= 90, "EXCELLENT").when(F.col("score") >= 70, "GOOD").when(F.col("score") >= 50, "ACCEPTABLE").otherwise("POOR")
    return df.withColumn("score", score).withColumn("issues", issues).withColumn("class", named)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent of all): the total is a window over the few aggregated rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.select(column, "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("percent"))


def distribution(df: DataFrame, value: str, high: float, medium: float, part: str = "video_id", digits: int | None = 6) -> DataFrame:
    """Mean, median, population deviation and the shares at or above two levels, per entity."""
    share = lambda t: F.avg(F.when(F.col(value) >= t, 1.0).otherwise(0.0))
    found = {"mean": F.avg(value), "median": F.percentile(value, 0.5), "deviation": F.stddev_pop(value), "high_share": share(high), "medium_share": share(medium)}
    return df.groupBy(part).agg(*[(v if digits is None else F.round(v, digits)).alias(k) for k, v in found.items()])


def video_type(shares: DataFrame, part: str = "video_id") -> DataFrame:
    """Type and dedup threshold by the share of very similar neighbours (strictly above .30 and .15)."""
    s = F.col("high_share")
    kind = F.when(s > 0.30, "INCREMENTAL_WRITING").when(s > 0.15, "MIXED").otherwise("DISCRETE_SLIDES")
    return shares.select(part, kind.alias("video_type"), F.when(s > 0.30, 0.80).when(s > 0.15, 0.85).otherwise(0.92).alias("threshold"))


def impact(df: DataFrame, value: str, thresholds: list[float], part: str = "video_id") -> DataFrame:
    """Per entity and threshold: duplicates, slides in all, slides left, reduction in percent.

    Counts per threshold come from one pass; the thresholds are unpivoted after the aggregate.
    """
    sums = df.groupBy(part).agg((F.count("*") + 1).alias("total"), *[F.count_if(F.col(value) >= t).alias(f"n{i}") for i, t in enumerate(thresholds)])
    rows = F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("duplicates")) for i, t in enumerate(thresholds)]))
    return sums.select(part, "total", rows).select(part, "threshold", "duplicates", "total", (F.col("total") - F.col("duplicates")).alias("final"), F.round(100.0 * F.col("duplicates") / F.col("total"), 6).alias("reduction_percent"))


def text_status(df: DataFrame, text: str, confidence: str, least: float = 0.75) -> DataFrame:
    """df with status: EMPTY before LOW_CONFIDENCE before OK."""
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    return df.withColumn("status", F.when(empty, "EMPTY").when(F.col(confidence) < least, "LOW_CONFIDENCE").otherwise("OK"))
