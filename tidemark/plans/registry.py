"""Where queries and the SQL that checks them are registered, and the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register the decorated function under its name, with its SQL if it has one."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ordered signals: (video_id, event_id, frame_index, t, signal, label, event_type)."""
    epoch = "unix_micros(cast(timestamp_ntz '1970-01-01 00:00:00' as timestamp))"
    # renamed below the window, so that windows and joins by video_id reuse its exchange
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "video_id")
    w = Window.partitionBy("video_id").orderBy("ts", "event_id")
    return e.select(
        "video_id",
        "event_id",
        (F.row_number().over(w) - 1).cast("long").alias("frame_index"),
        (F.expr(f"unix_micros(cast(ts as timestamp)) - {epoch}") / F.lit(1e6)).alias("t"),
        F.col("value").alias("signal"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        "event_type",
    )


FRAMES = """frames AS (SELECT user_id AS video_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
    epoch_us(ts) / 1e6 AS t, value AS signal, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, event_type FROM events)"""


def r6(c: Column | str) -> Column:
    return F.round(c, 6)
