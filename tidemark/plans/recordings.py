"""Queries over recordings: the frames of the slide table written as recordings and read through the frame source."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.features import extract_features
from ..sources import frames
from .registry import query, r6
from .slides import _PX, SIDE, slides

FPS, TARGET = 30, 5.0


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary folder stands in on a local master only."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{root or tempfile.mkdtemp(prefix='tidemark-')}/{name}-{uuid.uuid4().hex}"


def recorded(spark: SparkSession, sf_dir: str) -> str:
    """The slides of each label as a recording of 8 x 8 gray frames in order of vec_id; returns its folder."""
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id")) - 1
    data = F.unhex(F.array_join(F.transform("px", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    made = slides(spark, sf_dir).select(F.col("video_id").cast("string").alias("video_id"), number.cast("long").alias("frame_no"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), data.alias("data"))
    path = shared_path(spark, "recordings")
    frames.write_frames(made, path, FPS, piece=64)
    return path


def _pixels(data: str) -> Column:
    """The bytes of a gray frame as numbers."""
    return F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(F.col(data), i, F.lit(1))), 16, 10).cast("int"))


_FRAMES = f"{_PX}, numbered AS (SELECT label::VARCHAR AS video_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no FROM embeddings)"
_STEP = max(1, int(FPS / TARGET))


@query(f"""WITH {_FRAMES} SELECT n.video_id, frame_no, frame_no // {_STEP} AS sample, round(frame_no / {FPS}.0, 6) AS seconds, sum(v)::BIGINT AS light, min(v) AS darkest, max(v) AS lightest
FROM numbered n JOIN px USING (vec_id) WHERE frame_no % {_STEP} = 0 GROUP BY n.video_id, frame_no""")
def scan_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled frames of all recordings, with sums of their pixels."""
    found = frames.read_frames(spark, recorded(spark, sf_dir), TARGET).withColumn("px", _pixels("data"))
    light = F.aggregate("px", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("video_id", "frame_no", "sample", r6("t").alias("seconds"), light.alias("light"), F.array_min("px").alias("darkest"), F.array_max("px").alias("lightest"))


@query(f"""WITH {_FRAMES}, wanted AS (SELECT label::VARCHAR AS video_id, vec_id, (vec_id % 97) / 20.0 AS at FROM embeddings WHERE vec_id % 5 = 0),
found AS (SELECT w.video_id, w.vec_id, n.frame_no, n.vec_id AS frame FROM wanted w JOIN numbered n ON n.video_id = w.video_id AND n.frame_no = floor(w.at * {FPS})::BIGINT)
SELECT f.video_id, f.vec_id, frame_no, sum(v)::BIGINT AS light FROM found f JOIN px ON px.vec_id = f.frame GROUP BY ALL""")
def seek_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at wanted times of their recording; the wanted range bounds what the source reads."""
    path = recorded(spark, sf_dir)
    points = slides(spark, sf_dir).where("vec_id % 5 = 0").select(F.col("video_id").cast("string").alias("video_id"), "vec_id", (F.col("vec_id") % 97 / F.lit(20.0)).alias("at"))
    source = frames.read_frames(spark, path).where(F.col("frame_no") <= int(96 / 20 * FPS))
    light = F.aggregate(_pixels("data"), F.lit(0).cast("long"), lambda s, x: s + x)
    return frames.frames_at(source, points, FPS, "at").select("video_id", "vec_id", "frame_no", light.alias("light"))


_LOOP = f"""WITH {_FRAMES}, sampled AS (SELECT video_id, vec_id, frame_no // {_STEP} AS k, lag(vec_id) OVER (PARTITION BY video_id ORDER BY frame_no) AS before FROM numbered WHERE frame_no % {_STEP} = 0),
pairs AS (SELECT s.video_id, s.k, a.x, a.y, a.v::DOUBLE AS a, b.v::DOUBLE AS b FROM sampled s JOIN px a USING (vec_id) JOIN px b ON b.vec_id = s.before AND b.i = a.i),
corners AS (SELECT unnest([0, 0, 1, 1]) AS cx, unnest([0, 1, 0, 1]) AS cy),
boxes AS (SELECT video_id, k, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS vab FROM pairs JOIN corners ON x BETWEEN cx AND cx + 6 AND y BETWEEN cy AND cy + 6 GROUP BY video_id, k, cx, cy),
alike AS (SELECT video_id, k, avg((2 * ma * mb + 6.5025) * (2 * vab + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))) AS s FROM boxes GROUP BY video_id, k),
dark AS (SELECT video_id, k, avg(CASE WHEN a < 50 THEN 1 ELSE 0 END) AS black, avg((a - b) * (a - b)) AS mse FROM pairs GROUP BY video_id, k),
held AS (SELECT video_id, k, s, avg(s) OVER w AS m, stddev_pop(s) OVER w AS d, max(s) OVER w AS x FROM alike WINDOW w AS (PARTITION BY video_id ORDER BY k ROWS 9 PRECEDING))
SELECT n.video_id, n.k::INT AS frame_index, round(n.k * {_STEP} / {FPS}.0, 6) AS seconds, round(coalesce(black, 0), 6) AS black_pixel_ratio, 0.0::DOUBLE AS skin_pixel_ratio, round(coalesce(black, 0), 6) AS teacher_presence,
round(coalesce(s, 0), 6) AS global_ssim, round(coalesce(mse, 0), 6) AS global_mse, round(coalesce(m, 0), 6) AS ssim_rolling_mean, round(coalesce(d, 0), 5) AS ssim_rolling_std, round(coalesce(x, 0), 6) AS ssim_rolling_max
FROM sampled n LEFT JOIN held h USING (video_id, k) LEFT JOIN dark d USING (video_id, k)"""


def _loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_features(frames.read_frames(spark, recorded(spark, sf_dir), TARGET), stretch=16)


@query(_LOOP)
def feature_loop_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of the frame loop that SQL can say; stretches are short, so that recordings span several."""
    found = _loop(spark, sf_dir)
    rounded = [F.round(c, 5 if c.endswith("_std") else 6).alias(c) for c in ("black_pixel_ratio", "skin_pixel_ratio", "teacher_presence", "global_ssim", "global_mse", "ssim_rolling_mean", "ssim_rolling_std", "ssim_rolling_max")]
    return found.select("video_id", "frame_index", r6("timestamp_seconds").alias("seconds"), *rounded)


@query()
def feature_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 21 columns of the frame loop; edges and histograms have no SQL form."""
    return _loop(spark, sf_dir)
