"""Window operators over ordered rows of an entity.

All take the partition and order columns by name, add columns and keep rows; each is one
shuffle by the partition key, and operators that share partition and order share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PART, ORDER = "video_id", "frame_index"


def ordered(part: str = PART, *order: str) -> WindowSpec:
    return Window.partitionBy(part).orderBy(*(order or (ORDER,)))


def lag_change(df: DataFrame, value: str, out: str, signed: bool = True, part: str = PART, order: str = ORDER) -> DataFrame:
    """Difference to the row before; 0 on the first row."""
    diff = F.col(value) - F.lag(value).over(ordered(part, order))
    return df.withColumn(out, F.coalesce(diff if signed else F.abs(diff), F.lit(0.0)))


def rolling_stats(df: DataFrame, value: str, rows: int, skip_first: bool, part: str = PART, order: str = ORDER) -> DataFrame:
    """Mean, population deviation and maximum over the last `rows` rows, itself included.

    skip_first leaves the entity's first row out of all windows and gives it zeros.
    """
    first = F.row_number().over(ordered(part, order)) == 1
    marked = df.withColumn("_v", F.when(~first, F.col(value))) if skip_first else df.withColumn("_v", F.col(value))
    w = ordered(part, order).rowsBetween(1 - rows, 0)
    zero = F.lit(0.0)
    return marked.withColumns({"rolling_mean": F.coalesce(F.avg("_v").over(w), zero), "rolling_std": F.coalesce(F.stddev_pop("_v").over(w), zero), "rolling_max": F.coalesce(F.max("_v").over(w), zero)}).drop("_v")


def decay_slope(df: DataFrame, value: str, rows: int, out: str = "slope", part: str = PART, order: str = ORDER) -> DataFrame:
    """Least-squares slope of value against its row ordinal over the last `rows` rows; 0 with fewer than two."""
    w = ordered(part, order).rowsBetween(1 - rows, 0)
    ranked = df.withColumn("_x", F.row_number().over(ordered(part, order)).cast("double"))
    return ranked.withColumn(out, F.when(F.count(value).over(w) < 2, F.lit(0.0)).otherwise(F.coalesce(F.regr_slope(F.col(value), F.col("_x")).over(w), F.lit(0.0)))).drop("_x")


def warmup_padding(df: DataFrame, value: str, rows: int, part: str = PART, order: str = ORDER) -> DataFrame:
    """The first `rows` rows take the value of row `rows` where the entity has more rows than that."""
    at = F.max(F.when(F.col(order) == rows, F.col(value))).over(Window.partitionBy(part))
    n = F.count("*").over(Window.partitionBy(part))
    return df.withColumn(value, F.when((F.col(order) < rows) & (n > rows), at).otherwise(F.col(value)))


def minmax_scale(df: DataFrame, value: str, out: str, part: str = PART) -> DataFrame:
    """(value - min) / (max - min) within the entity; 0 where the range is at most 1e-10."""
    w = Window.partitionBy(part)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(high - low <= 1e-10, F.lit(0.0)).otherwise((F.col(value) - low) / (high - low)))


def previous_interval(df: DataFrame, time: str, start: str = "start", part: str = PART) -> DataFrame:
    """[previous time, time], from 0 for the first, and its duration."""
    return df.withColumn(start, F.coalesce(F.lag(time).over(ordered(part, time)), F.lit(0.0))).withColumn("duration", F.col(time) - F.col(start))


def next_interval(df: DataFrame, time: str, last_end: Column, end: str = "end", part: str = PART) -> DataFrame:
    """[time, next time), the last one up to last_end."""
    return df.withColumn(end, F.coalesce(F.lead(time).over(ordered(part, time)), last_end))


def renumber(df: DataFrame, *order: str, out: str = "index", part: str = PART) -> DataFrame:
    """1, 2, ... within the entity."""
    return df.withColumn(out, F.row_number().over(ordered(part, *order)).cast("long"))


def position_share(part: str = PART, order: str = ORDER) -> Column:
    """Ordinal over the entity's last ordinal, 0 for a single row."""
    return (F.row_number().over(ordered(part, order)) - 1) / F.greatest(F.count("*").over(Window.partitionBy(part)) - 1, F.lit(1))


def before_last(df: DataFrame, time: str, part: str = PART) -> DataFrame:
    """Rows ahead of the entity's last time."""
    return df.withColumn("_last", F.max(time).over(Window.partitionBy(part))).where(F.col(time) < F.col("_last")).drop("_last")


def adaptive_threshold(df: DataFrame, score: str, threshold: float, part: str = PART) -> DataFrame:
    """Rows at or above the threshold; entities without one use max(p99, mean + 2 deviations) instead.

    The statistics are one aggregate per entity, joined back.
    """
    stats = df.groupBy(part).agg(
        F.max(score).alias("_max"),
        F.greatest(F.percentile(score, 0.99), F.avg(score) + 2 * F.stddev_pop(score)).alias("_other"),
    )
    used = F.when(F.col("_max") >= threshold, F.lit(threshold)).otherwise(F.col("_other"))
    return df.join(stats.select(part, used.alias("threshold")), part).where(F.col(score) >= F.col("threshold"))
