"""Sources: explicit schemas, tolerant documents, ground truth lines, media files, frames."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 21 feature columns in their order.
FEATURES = (
    "black_pixel_ratio skin_pixel_ratio teacher_presence global_ssim global_mse histogram_correlation edge_count edge_change_rate "
    "zone_left_ssim zone_center_ssim zone_right_ssim zone_left_edge_density zone_center_edge_density zone_right_edge_density "
    "ssim_rolling_mean ssim_rolling_std ssim_rolling_max edge_rolling_mean edge_rolling_std edge_rolling_max edge_decay_velocity"
).split()
IDS = ("video_id", "frame_index", "timestamp_seconds", "label")
FEATURE_SCHEMA = T.StructType(
    [T.StructField("video_id", T.StringType()), T.StructField("frame_index", T.IntegerType()), T.StructField("timestamp_seconds", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in FEATURES]
    + [T.StructField("label", T.IntegerType())]
)
_WINDOW = T.StructType([T.StructField(c, T.DoubleType()) for c in ("start", "end", "duration")])
_TRANSITION = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("timestamp_formatted", T.StringType()),
        T.StructField("is_blank", T.BooleanType()),
        T.StructField("ssim_score", T.DoubleType()),
        T.StructField("ssim_from_prev", T.DoubleType()),
        T.StructField("edge_count", T.DoubleType()),
        T.StructField("has_audio", T.BooleanType()),
        T.StructField("audio_window", _WINDOW),
        T.StructField("preview_image", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)
#: Both versions of the transitions document; the columns that a version lacks are null.
TRANSITIONS_SCHEMA = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("total_transitions", T.LongType()),
        T.StructField("blank_count", T.LongType()),
        T.StructField("blank_transitions", T.LongType()),
        T.StructField("transitions", T.ArrayType(_TRANSITION)),
    ]
)
IMAGES = ("jpg", "png", "jpeg")
VIDEOS = ("mp4", "avi", "mov", "mkv", "flv", "wmv")
AUDIO = ("mp3", "wav", "m4a", "mp4", "avi")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature CSV files of a folder or glob; the id of a file without the column comes from its name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(_features)?\.csv$", 1)
    return spark.read.schema(FEATURE_SCHEMA).csv(path, header=True).withColumn("video_id", F.coalesce("video_id", name))


def feature_columns(df: DataFrame) -> list[str]:
    """Everything but the ids."""
    return [c for c in df.columns if c not in IDS]


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    """One row per transition of JSON documents: {transitions: [...]} in either version, or a bare list.

    Empty files and invalid JSON give no rows.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("folder"))
    document = F.from_json("raw", TRANSITIONS_SCHEMA)
    bare = F.from_json("raw", T.ArrayType(_TRANSITION))
    is_list = F.ltrim("raw").startswith("[")
    rows = raw.select("folder", document["video_id"].alias("named"), F.when(is_list, bare).otherwise(document["transitions"]).alias("t"))
    each = rows.select(F.coalesce("named", "folder").alias("video_id"), F.explode("t").alias("t"))
    return each.select("video_id", "t.*").withColumn("similarity", F.coalesce("ssim_score", "ssim_from_prev")).where(F.col("timestamp").isNotNull())


def parse_times(lines: DataFrame, column: str, out: str = "t") -> DataFrame:
    """Rows whose line is a number, as double; blank lines, # comments and other text go."""
    line = F.btrim(F.col(column), F.lit(" \t\r\n"))
    return lines.where((line != "") & ~line.startswith("#")).withColumn(out, line.try_cast("double")).where(F.col(out).isNotNull())


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, t) of text files one number per line; the id is the file's folder."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("video_id"), "value")
    return parse_times(lines, "value").select("video_id", "t")


def list_files(spark: SparkSession, folder: str, extensions: Iterable[str]) -> DataFrame:
    """(path, name, stem, ext) of files with one of the extensions in either case, sorted by path; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    found = files.select("path", "length", "modificationTime", name.alias("name")).withColumns({"stem": F.regexp_replace("name", r"\.[^.]*$", ""), "ext": F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))})
    return found.where(F.col("ext").isin(*extensions)).distinct().orderBy("path")


def pick_by_extension(files: DataFrame, extensions: Iterable[str]) -> DataFrame:
    """Of files with the same stem the one whose extension comes first."""
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    w = Window.partitionBy("stem").orderBy("rank", "path")
    return files.withColumn("rank", rank).where("rank > 0").withColumn("k", F.row_number().over(w)).where("k = 1").drop("rank", "k")


def decode_npy(content: bytes) -> tuple[np.ndarray, float]:
    """Frames (n, height, width[, 3]) of a numpy file, 30 a second: the built-in decoder."""
    return np.load(io.BytesIO(content), allow_pickle=False), 30.0


FRAME_SCHEMA = "video_id string, frame_no long, sample long, t double, height int, width int, data binary"


#: Bytes of frames that leave a scan at once.
BATCH_BYTES = 1 << 24


def scan_frames(files: DataFrame, decoder: Callable[[bytes], tuple[np.ndarray, float]] = decode_npy, target_fps: float = 5.0) -> DataFrame:
    """Sampled frames of media files (path, content): every max(1, int(fps / target))-th one.

    A file is decoded in one task and its frames leave in batches of about BATCH_BYTES; a file that cannot be decoded
    raises with its path. Other formats come with their own decoder.
    """

    columns = ["video_id", "frame_no", "sample", "t", "height", "width", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in batch[["path", "content"]].itertuples(index=False):
                try:
                    frames, fps = decoder(content)
                except Exception as error:
                    raise ValueError(f"cannot decode {path}") from error
                skip = max(1, int(fps / target_fps))
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows, held = [], 0
                for k, n in enumerate(range(0, len(frames), skip)):
                    f = frames[n]
                    rows.append((name, n, k, n / fps, f.shape[0], f.shape[1], f.astype(np.uint8).tobytes()))
                    held += len(rows[-1][-1])
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, FRAME_SCHEMA)
