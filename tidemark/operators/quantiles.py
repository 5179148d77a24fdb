"""Exact percentiles of any number of values per key, without a task that holds a key's values.

A sketch (mergeable, of bounded size) first tells two values between which each wanted rank surely lies. Then one pass counts
what is below and groups the values in between, some parts in `accuracy` of all, by value: the wanted ranks are
picked from running counts of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One part in ACCURACY of the rows is the greatest rank error of the sketch.
ACCURACY = 10_000


def _at(rank: Column) -> Column:
    """The value whose running count first exceeds rank (from 0)."""
    return F.min(F.when(F.col("_upto") > rank, F.col("_v")))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys, share, n, percentile): percentiles of value by keys, linear between neighbouring ranks as share * (n - 1) falls.

    Nulls are left out, keys may be null, and a key without values has no rows; NaN counts as the greatest value. A rank outside its
    sketched range, which the sketch's bound rules out, raises an error instead of a wrong value.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    slack = 4 / accuracy
    bounds = [x for s in shares for x in (max(0.0, s - slack), min(1.0, s + slack))]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", bounds, accuracy).alias("_b"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    # at either end the range is open; of few rows all are in it, for a part of them may be less than a rank
    few = F.col("n") <= 2 * accuracy
    low = lambda k: F.when(few | F.lit(bounds[2 * k] == 0.0), F.col("_least")).otherwise(F.get("_b", F.lit(2 * k)))
    high = lambda k: F.when(few | F.lit(bounds[2 * k + 1] == 1.0), F.col("_most")).otherwise(F.get("_b", F.lit(2 * k + 1)))
    ranges = [F.struct(F.lit(float(s)).alias("share"), low(k).alias("low"), high(k).alias("high")) for k, s in enumerate(shares)]
    wanted = sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", F.array(*ranges).alias("_r"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    # equal values meet before they are compared with the ranges, and what lies below a range is only counted
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    met = (counted.join(wanted, same) if keys else counted.crossJoin(F.broadcast(wanted))).select(*keys, "n", "_v", "_c", F.explode("_r").alias("r"))  # without keys: one row of bounds
    placed = met.where(F.col("_v") <= F.col("r.high")).select(*keys, "n", "r.share", F.when(F.col("_v") >= F.col("r.low"), F.col("_v")).alias("_v"), "_c")
    sums = placed.groupBy(*keys, "n", "share", "_v").agg(F.sum("_c").alias("_c"))
    # the row without a value holds the count of what is below; it sorts first
    upto = F.sum("_c").over(Window.partitionBy(*keys, "share").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.col("share") * (F.col("n") - 1)
    ranked = sums.withColumn("_upto", upto).groupBy(*keys, "share", "n").agg(
        _at(F.floor(rank)).alias("_a"), _at(F.ceil(rank)).alias("_z"), F.max(F.when(F.col("_v").isNull(), F.col("_c"))).alias("_below"), F.max("_upto").alias("_seen")
    )
    sure = (F.coalesce("_below", F.lit(0)) <= F.floor(rank)) & (F.col("_seen") > F.ceil(rank))
    part = rank - F.floor(rank)
    found = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(F.col("_a") + (F.col("_z") - F.col("_a")) * part)
    return ranked.select(*keys, "share", "n", F.when(sure, found).otherwise(F.raise_error(F.lit("a rank lies outside its sketched range"))).alias("percentile"))
