"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mmss(seconds: Column) -> Column:
    """MM:SS with unbounded minutes."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60)))


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, from its exact binary value and ties to even, as C and Python print it; format_string() rounds the shortest decimal form of x, halves up."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def proximity(t: Column, start: Column, end: Column) -> Column:
    """Position of t in [start, end]; 1 in an empty window."""
    return F.when(end == start, F.lit(1.0)).otherwise((t - start) / (end - start))


def cube_root(x: Column) -> Column:
    return F.pow(x, F.lit(1 / 3))


def teacher_penalty(presence: Column) -> Column:
    return 1 / (1 + 5 * presence)


def brightness_quality(mean: Column) -> Column:
    """1 in [80, 150]; falls linearly to both sides of that, to .3 at least."""
    return F.when(mean.between(80, 150), F.lit(1.0)).when(mean < 80, F.greatest(mean / 80, F.lit(0.3))).otherwise(F.greatest((255 - mean) / 105, F.lit(0.3)))


def guarded_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def deck_id(name: Column) -> Column:
    """A stable deck number of ten digits at most."""
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"), F.lit(10_000_000_000))
