"""Band and interval joins.

Every join has the entity and a bucket of time as equality keys: rows of the right side stand in the bucket of their
time, those of the left in all buckets that their band touches, two or three where buckets are as wide as bands. So an entity of
any length spreads over its buckets and a row meets only rows near it; the band itself is a residual condition.
The choice among the matches of a row is an aggregate of one struct, which combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ORDER, PART


def band_join(points: DataFrame, frames: DataFrame, low: Column, high: Column, width: float, how: str = "inner", time: str = "t", part: str = PART) -> DataFrame:
    """points as p and frames as f of the same entity whose time lies in [low, high], in buckets of width.

    Each pair comes once, for a frame stands in one bucket. A left join gives a point a row without frame for each of its buckets
    that has none, so aggregates of points must ignore nulls, as all here do. Points of an empty or null band match nothing.
    """
    bucket = lambda c: F.floor(c / F.lit(float(width)))
    touched = F.when(low <= high, F.sequence(bucket(low), bucket(high)))
    p = points.withColumns({"_low": low, "_high": high, "_bucket": F.explode_outer(touched)}).alias("p")
    f = frames.withColumn("_bucket", bucket(F.col(time))).alias("f")
    near = (F.col(f"p.{part}") == F.col(f"f.{part}")) & (F.col("p._bucket") == F.col("f._bucket")) & F.col(f"f.{time}").between(F.col("p._low"), F.col("p._high"))
    return p.join(f, near, how)


def snap_to_min(points: DataFrame, frames: DataFrame, width: float, score: str, point: str = "point_id", time: str = "t", part: str = PART) -> DataFrame:
    """Each point's frame of least score within width of its time (lowest number of equals); points without one are dropped."""
    near = band_join(points, frames, F.col(time) - width, F.col(time) + width, 2 * width, time=time, part=part)
    best = F.min(F.struct(F.col(f"f.{score}").alias("s"), F.col(f"f.{ORDER}").alias("i"))).alias("b")
    return near.groupBy(F.col(f"p.{part}").alias(part), F.col(f"p.{point}").alias(point)).agg(best).select(part, point, F.col("b.i").alias(ORDER), F.col("b.s").alias(score))


def context_labels(frames: DataFrame, snapped: DataFrame, context: int, part: str = PART, order: str = ORDER) -> DataFrame:
    """frames with near: 1 within `context` row numbers of a snapped frame.

    Snapped numbers join the frames as rows of their own, and a range of the window finds them: no join, and both
    sides keep the partitioning by entity that they have.
    """
    own = F.struct(*frames.columns).alias("_row")
    marks = snapped.select(part, order, F.lit(1).alias("_hit"), F.lit(None).cast(frames.select(own).schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(part).orderBy(order).rangeBetween(-context, context)
    both = frames.select(part, order, F.lit(0).alias("_hit"), own).unionByName(marks)
    return both.withColumn("near", F.max("_hit").over(w)).where(F.col("_row").isNotNull()).select("_row.*", "near")


def nearest_default(left: DataFrame, features: DataFrame, width: float, value: str, default: float, key: str = "event_id", time: str = "t", part: str = PART) -> DataFrame:
    """left's keys with the value of the first feature row within width, else the default."""
    # the sum is rounded and the difference decides, so the band of the join is wider by a little
    slack = width * 1e-9 + F.abs(F.col(time)) * 1e-12
    near = band_join(left, features, F.col(time) - width - slack, F.col(time) + width + slack, 2 * width, "left", time, part)
    inside = F.col(f"f.{ORDER}").isNotNull() & (F.abs(F.col(f"f.{time}") - F.col(f"p.{time}")) <= width)
    first = F.min(F.when(inside, F.struct(F.col(f"f.{ORDER}").alias("i"), F.col(f"f.{value}").alias("v")))).alias("b")
    return near.groupBy(F.col(f"p.{part}").alias(part), F.col(f"p.{key}").alias(key)).agg(first).select(part, key, F.coalesce("b.v", F.lit(default)).alias(value))


def best_in_window(points: DataFrame, frames: DataFrame, lookback: float, score: str, margin: float, point: str = "event_id", time: str = "t", part: str = PART) -> DataFrame:
    """The frame of greatest score in each point's window, the earliest of equals; a point without frames falls back to its time and score 0.

    The window is [max(t - lookback, previous + margin), t - margin]; where that is empty,
    from max(0, t - 2 margin) to max(start + margin, t - margin / 2).
    """
    before = F.coalesce(F.lag(time).over(Window.partitionBy(part).orderBy(time)), F.lit(0.0))
    t = F.col(time)
    wide = points.withColumn("_a", F.greatest(t - lookback, before + margin)).withColumn("_b", t - margin)
    narrow = F.greatest(F.lit(0.0), t - 2 * margin)
    bad = F.col("_a") >= F.col("_b")
    windows = wide.select(part, point, time, F.when(bad, narrow).otherwise(F.col("_a")).alias("ws"), F.when(bad, F.greatest(narrow + margin, t - margin / 2)).otherwise(F.col("_b")).alias("we"))
    near = band_join(windows, frames, F.col("ws"), F.col("we"), max(lookback, 2 * margin), "left", time, part)
    top = F.max(F.when(F.col(f"f.{ORDER}").isNotNull(), F.struct(F.col(f"f.{score}").alias("s"), (-F.col(f"f.{ORDER}")).alias("n"), F.col(f"f.{time}").alias("t")))).alias("b")
    best = near.groupBy(F.col(f"p.{part}").alias(part), F.col(f"p.{point}").alias(point), F.col(f"p.{time}").alias("transition")).agg(top, F.count(f"f.{ORDER}").alias("n_frames"))
    return best.select(part, point, F.coalesce("b.t", "transition").alias("capture"), F.coalesce("b.s", F.lit(0.0)).alias("best_score"), "n_frames")


def align_segments(slides: DataFrame, segments: DataFrame, part: str = PART) -> DataFrame:
    """Texts of the segments wholly inside each slide's [start, end], in time order; '' without any."""
    s, g = slides.alias("s"), segments.alias("g")
    inside = (F.col(f"s.{part}") == F.col(f"g.{part}")) & (F.col("g.seg_start") >= F.col("s.start")) & (F.col("g.seg_end") <= F.col("s.end"))
    rows = s.join(g, inside, "left").groupBy(F.col(f"s.{part}").alias(part), F.col("s.index").alias("index")).agg(F.sort_array(F.collect_list(F.when(F.col("g.seg_start").isNotNull(), F.struct("g.seg_start", "g.seg_text")))).alias("_g"))
    return rows.select(part, "index", F.array_join(F.transform("_g", lambda x: x["seg_text"]), " ").alias("transcript"), F.size("_g").cast("long").alias("n_segments"))


def zip_by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str, part: str = PART) -> DataFrame:
    """Rows of both sides paired by ordinal; the longer side is cut."""
    number = lambda df, order: df.withColumn("position", F.row_number().over(Window.partitionBy(part).orderBy(order)).cast("long"))
    return number(left, left_order).join(number(right, right_order), [part, "position"])
