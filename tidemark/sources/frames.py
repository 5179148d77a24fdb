"""Frames of uncompressed recordings (.y4m) as a Spark data source, read and written.

Reading: a recording is cut into ranges of frames, each a partition that seeks to its bytes, so one long recording
spreads over many tasks. Filters on video_id and frame_no choose recordings and ranges before any
task starts. Stores are reached through pyarrow's file systems (local, hdfs, s3, ...).

    register(spark)
    spark.read.format("frames").option("path", folder).option("target_fps", 5).load()
    df.write.format("frames").option("path", folder).option("fps", 30).mode("append").save()

A file may be a piece of a recording: the number in front of its ending is that of its first frame. Columns are those of
FRAME_SCHEMA; data holds gray bytes of mono recordings and blue, green, red bytes of others; sample counts the frames
that target_fps leaves (every max(1, int(fps / target_fps))-th one), from 0 in the whole recording.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .readers import BATCH_BYTES, FRAME_SCHEMA

#: Bytes of frames that one task reads.
TASK_BYTES = 1 << 26
# Signature, frame marker and the planes of the colour spaces read (share of a full plane in each).
SIGNATURE, MARKER = b"YUV4MPEG2", b"FRAME"
PLANES = {"mono": (1,), "444": (1, 1, 1), "420": (1, 0.25, 0.25), "420jpeg": (1, 0.25, 0.25), "420mpeg2": (1, 0.25, 0.25), "420paldv": (1, 0.25, 0.25)}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path within it; a plain path is local."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass(frozen=True)
class Recording(InputPartition):
    """Where the frames of a file are: frame k (from 0 in the file) has its marker at starts[k], or at start + k * (marker + frame) where starts is empty."""

    path: str
    video_id: str
    first: int
    height: int
    width: int
    fps: Fraction
    colour: str
    start: int
    n: int
    starts: tuple[int, ...] = ()

    @property
    def frame_bytes(self) -> int:
        if self.colour.startswith("420"):
            return self.height * self.width + 2 * (-(-self.height // 2) * -(-self.width // 2))
        return self.height * self.width * len(PLANES[self.colour])

    def at(self, k: int) -> int:
        return self.starts[k] if self.starts else self.start + k * (len(MARKER) + 1 + self.frame_bytes)


@dataclass(frozen=True)
class FrameRange(InputPartition):
    """The sampled frames of a recording with numbers in [low, high), all of it counted."""

    recording: Recording
    low: int
    high: int


def open_recording(path: str) -> Recording:
    """What the header and the size of a file tell; files whose frames carry parameters are walked from marker to marker."""
    store, inner = file_system(path)
    with store.open_input_file(inner) as f:
        head = f.read(4096).split(b"\n", 1)[0].decode("ascii", "replace").split(" ")
        if head[0] != SIGNATURE.decode():
            raise ValueError(f"{path} is not a recording of this format")
        tags = {x[0]: x[1:] for x in head[1:] if x}
        colour = tags.get("C", "420jpeg")
        if colour not in PLANES or not {"W", "H", "F"} <= tags.keys():
            raise ValueError(f"{path} has a colour space or header that cannot be read: {' '.join(head)}")
        start, size = len(" ".join(head)) + 1, f.size()
        stem = inner.rsplit("/", 1)[-1].removesuffix(".y4m")
        piece = re.fullmatch(r"(.*)\.(\d{9,})", stem)
        name, first = (piece[1], int(piece[2])) if piece else (stem, 0)
        found = Recording(path, unquote(name), first, int(tags["H"]), int(tags["W"]), Fraction(tags["F"].replace(":", "/")), colour, start, 0)
        whole = len(MARKER) + 1 + found.frame_bytes
        n, rest = divmod(size - start, whole)
        f.seek(found.at(max(n - 1, 0)))
        if rest == 0 and (n == 0 or f.read(len(MARKER) + 1) == MARKER + b"\n"):
            return Recording(**{**found.__dict__, "n": n})
        starts, at = [], start
        while at < size:
            f.seek(at)
            line = f.read(256).split(b"\n", 1)[0]
            if not line.startswith(MARKER) or at + len(line) + 1 + found.frame_bytes > size:
                raise ValueError(f"{path} is damaged at byte {at}")
            starts.append(at)
            at += len(line) + 1 + found.frame_bytes
        return Recording(**{**found.__dict__, "n": len(starts), "starts": tuple(starts)})


def picture(raw: bytes, r: Recording) -> bytes:
    """Gray bytes, or blue, green and red from luma and two colour differences (studio range; full range for 420jpeg)."""
    if r.colour == "mono":
        return raw
    h, w = r.height, r.width
    luma = np.frombuffer(raw, np.uint8, h * w).reshape(h, w).astype(np.float64)
    if r.colour == "444":
        u, v = np.frombuffer(raw, np.uint8, 2 * h * w, h * w).reshape(2, h, w).astype(np.float64)
    else:
        half = np.frombuffer(raw, np.uint8, offset=h * w).reshape(2, -(-h // 2), -(-w // 2)).astype(np.float64)
        u, v = half.repeat(2, 1).repeat(2, 2)[:, :h, :w]
    u, v = u - 128, v - 128
    # The BT.601 matrix.
    if r.colour == "420jpeg":
        planes = (luma + 1.772 * u, luma - 0.344136 * u - 0.714136 * v, luma + 1.402 * v)
    else:
        y = 1.164383 * (luma - 16)
        planes = (y + 2.017232 * u, y - 0.391762 * u - 0.812968 * v, y + 1.596027 * v)
    return np.clip(np.floor(np.stack(planes, -1) + 0.5), 0, 255).astype(np.uint8).tobytes()


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.target = float(options["target_fps"]) if "target_fps" in options else None
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.low, self.high, self.videos = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes bounds of frame_no and sets of video_id; Spark applies all filters again."""
        for f in filters:
            name, value = f.attribute, getattr(f, "value", None)
            if name == ("frame_no",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if name == ("frame_no",) and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                end = value + (not isinstance(f, LessThan))
                self.high = end if self.high is None else min(self.high, end)
            if name == ("frame_no",) and isinstance(f, In) and f.value:
                self.low = max(self.low, min(f.value))
                self.high = max(f.value) + 1 if self.high is None else min(self.high, max(f.value) + 1)
            if name == ("video_id",) and isinstance(f, EqualTo | In):
                wanted = set(f.value) if isinstance(f, In) else {value}
                self.videos = wanted if self.videos is None else self.videos & wanted
            yield f

    def step(self, r: Recording) -> int:
        return max(1, int(r.fps / Fraction(self.target))) if self.target else 1

    def partitions(self) -> list[FrameRange]:
        store, inner = file_system(self.path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [info] if info.is_file else store.get_file_info(fs.FileSelector(inner, recursive=True))
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        out = []
        for path in sorted(i.path for i in listed if i.is_file and i.path.endswith(".y4m") and "/_" not in i.path):
            name = re.sub(r"\.\d{9,}$", "", path.rsplit("/", 1)[-1].removesuffix(".y4m"))
            if self.videos is not None and unquote(name) not in self.videos:
                continue  # not even opened
            r = open_recording(prefix + path)
            low, high = max(self.low, r.first), r.first + r.n if self.high is None else min(self.high, r.first + r.n)
            each = max(1, self.task_bytes // max(1, r.frame_bytes)) * self.step(r)
            out += [FrameRange(r, at, min(at + each, high)) for at in range(low, high, each)]
        return out

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is left of the recordings
            return
        r, step = partition.recording, self.step(partition.recording)
        store, inner = file_system(r.path)
        rows, held = [], 0
        with store.open_input_file(inner) as f:
            for no in range(-(-partition.low // step) * step, partition.high, step):
                f.seek(r.at(no - r.first))
                if r.starts:
                    line = f.read(256).split(b"\n", 1)[0] + b"\n"
                    f.seek(r.at(no - r.first) + len(line))
                else:
                    line = f.read(len(MARKER) + 1)
                raw = f.read(r.frame_bytes)
                if not line.startswith(MARKER) or len(raw) != r.frame_bytes:
                    raise ValueError(f"{r.path} is damaged at frame {no}")
                rows.append((r.video_id, no, no // step, float(no / r.fps), r.height, r.width, picture(raw, r)))
                held += len(rows[-1][-1])
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["video_id", "frame_no", "sample", "t", "height", "width", "data"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


@dataclass
class Written(WriterCommitMessage):
    pieces: list[tuple[str, str]]


class FrameWriter(DataSourceWriter):
    """Each task writes a file per run of consecutive frames of a recording, cut at multiples of piece; files get their names when the whole job has succeeded."""

    def __init__(self, options: dict[str, str]):
        self.path, self.fps = options["path"].rstrip("/"), Fraction(options.get("fps", "30")).limit_denominator(1001)
        self.piece = int(options.get("piece", 1 << 16))
        self.job = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        store, root = file_system(self.path)
        job = root + self.job[len(self.path) :]
        store.create_dir(job)
        pieces, out, last = [], None, None
        for row in iterator:
            size = (row.height, row.width)
            if row.data is None or len(row.data) != row.height * row.width:
                raise ValueError(f"frame {row.frame_no} of {row.video_id} is not a gray picture")
            if last != (row.video_id, row.frame_no - 1, size) or row.frame_no % self.piece == 0:
                if out is not None:
                    out.close()
                pieces.append((f"{job}/{uuid.uuid4().hex}", f"{root}/{quote(row.video_id, safe='')}.{row.frame_no:09d}.y4m"))
                out = store.open_output_stream(pieces[-1][0])
                out.write(SIGNATURE + f" W{row.width} H{row.height} F{self.fps.numerator}:{self.fps.denominator} Ip A1:1 Cmono\n".encode())
            out.write(MARKER + b"\n" + bytes(row.data))
            last = (row.video_id, row.frame_no, size)
        if out is not None:
            out.close()
        return Written(pieces)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.path)
        for message in messages:
            for temporary, final in message.pieces if message else ():
                store.move(temporary, final)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        job = root + self.job[len(self.path) :]
        if store.get_file_info(job).type == fs.FileType.Directory:
            store.delete_dir(job)


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        if overwrite:
            raise ValueError("recordings are added, not overwritten")
        return FrameWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes format "frames" known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def read_frames(spark: SparkSession, path: str, target_fps: float | None = None, **options) -> DataFrame:
    register(spark)
    wanted = {"path": path, **options} | ({"target_fps": target_fps} if target_fps else {})
    return spark.read.format("frames").options(**wanted).load()


def write_frames(frames: DataFrame, path: str, fps: float | Fraction = 30, piece: int = 1 << 16) -> None:
    """frames (video_id, frame_no, height, width, data: gray) as recordings under path, in files of at most `piece` consecutive frames."""
    register(frames.sparkSession)
    cut = frames.selectExpr("video_id", "frame_no", f"frame_no div {piece} as _piece", "height", "width", "data")
    sorted_ = cut.repartition("video_id", "_piece").sortWithinPartitions("video_id", "_piece", "frame_no").drop("_piece")
    sorted_.selectExpr("video_id", "frame_no", "frame_no as sample", "double(0) as t", "height", "width", "data").write.format("frames").option("path", path).option("fps", str(Fraction(fps))).option("piece", piece).mode("append").save()


def frames_at(frames: DataFrame, points: DataFrame, fps: float, time: str = "t") -> DataFrame:
    """points (video_id, time, ...) with the frame whose number is floor(time * fps); points behind the last frame go."""
    wanted = points.withColumn("frame_no", F.floor(F.col(time) * fps).cast("long"))
    return wanted.join(frames.select("video_id", "frame_no", "height", "width", "data"), ["video_id", "frame_no"])
