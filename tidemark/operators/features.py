"""The whole frame loop as one distributed pass: 21 features of each frame, its predecessor and ten held values.

A recording is cut into stretches of frames. Each stretch also gets the WINDOW frames in front of it (the halo), which fill the
loop's state and give no rows, so the result is that of one loop over the recording. One exchange by (recording, stretch);
a task holds a frame and the state, whatever the length of the recording.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.readers import FEATURES

WINDOW = 10
STRETCH = 600
OUT_ROWS = 2048


def _slope(values: np.ndarray) -> float:
    """Least-squares slope over 0, 1, ...; 0 with fewer than two values."""
    if len(values) < 2:
        return 0.0
    x = np.arange(len(values)) - (len(values) - 1) / 2
    return float((x * values).sum() / (x * x).sum())


class FrameLoop:
    """State of the loop: the frame before, its edges, and the last WINDOW similarities and edge counts."""

    def __init__(self):
        self.before = self.edges = None
        self.ssim: deque[float] = deque(maxlen=WINDOW)
        self.counts: deque[int] = deque(maxlen=WINDOW)

    def step(self, frame: np.ndarray, is_first: bool) -> list[float]:
        """The features of the next frame in the order of FEATURES; a recording's first frame has its edge count alone."""
        colour = frame if frame.ndim == 3 else np.repeat(frame[..., None], 3, axis=-1)
        now = kernels.gray(frame)
        edges = kernels.canny(now)
        count = int(edges.sum())
        before, seen = self.before, self.edges
        self.before, self.edges = now, edges
        if is_first or before is None or before.shape != now.shape:
            self.ssim.clear()
            self.counts.clear()
            return [float(count) if name == "edge_count" else 0.0 for name in FEATURES]
        like = kernels.ssim(now, before)
        self.ssim.append(like)
        self.counts.append(count)
        black, skin = kernels.black_ratio(colour), kernels.skin_ratio(colour)
        zones = [self._zone(k, now, before, edges, seen) for k in range(3)]
        s, e = np.array(self.ssim), np.array(self.counts, np.float64)
        histogram = kernels.histogram_correlation(colour, np.repeat(before[..., None], 3, axis=-1))
        head = [black, skin, black + skin, like, kernels.mse(now, before), histogram, float(count), float(count - int(seen.sum()))]
        return [*head, *(z[0] for z in zones), *(z[1] for z in zones), s.mean(), s.std(), s.max(), e.mean(), e.std(), e.max(), _slope(e)]

    @staticmethod
    def _zone(k: int, now: np.ndarray, before: np.ndarray, edges: np.ndarray, seen: np.ndarray) -> tuple[float, float]:
        """Similarity and mean edge density of a third of the lowest fifth of rows."""
        third = now.shape[1] // 3
        cut = (slice(int(now.shape[0] * 0.8), None), slice(k * third, (k + 1) * third if k < 2 else None))
        area = edges[cut].size
        return kernels.ssim(now[cut], before[cut]), (edges[cut].sum() + seen[cut].sum()) / (2 * area) if area else 0.0


def extract_features(frames: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(video_id, frame_index, timestamp_seconds, the FEATURES, label 0) of sampled frames (video_id, sample, t, height, width, data).

    sample counts a recording's frames from 0 without gaps. A frame of another size than the one before starts anew.
    """
    if stretch < WINDOW:
        raise ValueError(f"a stretch has at least {WINDOW} frames")
    own = F.floor(F.col("sample") / stretch)
    halo = F.when(F.pmod(F.col("sample"), F.lit(stretch)) >= stretch - WINDOW, own + 1)
    parts = frames.select("video_id", "sample", "t", "height", "width", "data", F.explode(F.array_compact(F.array(own, halo))).alias("stretch"))
    names = ["video_id", "frame_index", "timestamp_seconds", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), *[pa.float64()] * (1 + len(FEATURES))]
        key, loop, rows = None, FrameLoop(), []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            columns = [batch.column(c) for c in ("video_id", "sample", "t", "height", "width", "data", "stretch")]
            for video, sample, t, height, width, data, at in zip(*columns, strict=True):
                video, sample, at = video.as_py(), sample.as_py(), at.as_py()
                if key != (video, at):
                    key, loop = (video, at), FrameLoop()
                values = loop.step(kernels.decode(data.as_py(), height.as_py(), width.as_py()), sample == 0)
                if sample // stretch == at:
                    rows.append((video, sample, t.as_py(), *map(float, values)))
                if len(rows) >= OUT_ROWS:
                    yield flush()
                    rows = []
        if rows:
            yield flush()

    schema = ", ".join(["video_id string, frame_index int, timestamp_seconds double", *(f"{c} double" for c in FEATURES)])
    # as many tasks as shuffles have: the work of a stretch is in its pixels, so small partitions must not be put together
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = parts.repartition(tasks, "video_id", "stretch").sortWithinPartitions("video_id", "stretch", "sample")
    return cut.mapInArrow(run, schema).withColumn("label", F.lit(0))
