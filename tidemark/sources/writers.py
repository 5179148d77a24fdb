"""Sinks: partitioned tables, versioned folders, nested documents, ordered text."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, format: str = "parquet", part: str = "video_id", files: int = 1) -> None:
    """One folder per entity with at most `files` files: the rows of an entity are dealt over so many tasks by their hash."""
    df.repartition(part, F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.partitionBy(part).format(format).option("header", "true").save(path)


def write_version(df: DataFrame, root: str, format: str = "parquet") -> str:
    """df as a new version under root, whose earlier versions stay; returns its path.

    Tables are never overwritten in place, so a job may read the version before.
    """
    path = f"{root}/v={datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    df.write.format(format).save(path)
    return path


def write_documents(df: DataFrame, path: str, part: str = "video_id") -> None:
    """A JSON document per row."""
    df.write.partitionBy(part).json(path)


def write_text(df: DataFrame, path: str, column: str, part: str = "video_id") -> None:
    """A text column in one folder per entity, rows as they are."""
    df.select(part, F.col(column).alias("value")).write.partitionBy(part).text(path)


def thumbnails(frames: DataFrame, width: int, enlarge: bool = True, quality: int | None = None, resize: str = "bilinear") -> DataFrame:
    """Frames (data, height, width) scaled to a width, aspect kept; without enlarge small frames stay.

    resize is "bilinear" or "area"; with a quality, data are JPEG files, else raw bytes. Null data stay as they are.
    """
    if resize not in ("bilinear", "area"):
        raise ValueError(resize)

    def run(batches):
        from ..functions.jpeg import jpeg
        from ..functions.kernels import decode, resize_area, resize_bilinear

        scaled = resize_area if resize == "area" else resize_bilinear
        for batch in batches:
            out = []
            for data, h, w in zip(batch["data"], batch["height"], batch["width"], strict=True):
                if data is None:
                    out.append((h, w, None))
                    continue
                to = width if enlarge else min(width, w)
                small = np.clip(np.rint(scaled(decode(data, h, w), max(1, int(h * (to / w))), to)), 0, 255).astype(np.uint8)
                out.append((small.shape[0], small.shape[1], small.tobytes() if quality is None else jpeg(small, quality)))
            made = pd.DataFrame(out, columns=["height", "width", "data"]).astype({"height": "int32", "width": "int32"})
            yield pd.concat([batch.drop(columns=["data", "height", "width"]).reset_index(drop=True), made], axis=1)

    kept = [f for f in frames.schema if f.name not in ("data", "height", "width")]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["height int", "width int", "data binary"])
    return frames.select(*[f.name for f in kept], "height", "width", "data").mapInPandas(run, schema)
