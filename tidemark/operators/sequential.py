"""Sequential deduplication: each item is compared with the last one accepted.

The state is a vector and a few scalars, so an entity is one ordered fold in a grouped
Arrow function; entities run in parallel. Similarity is a parameter (vectors in, number out).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold
from .windows import PART


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    na, nb = float(np.sqrt(a @ a)), float(np.sqrt(b @ b))
    return float(a @ b) / (na * nb) if na and nb else 0.0


def _fold(df: DataFrame, step: Callable[[pd.DataFrame], list[dict]], schema: str, part: str) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = step(group)
        out = pd.DataFrame(rows)
        out.insert(0, part, group[part].iloc[0])
        return out

    kind = df.schema[part].dataType.simpleString()
    return df.groupBy(part).applyInPandas(run, f"{part} {kind}, {schema}")


def keep_first(df: DataFrame, threshold: float, rapid: float, rapid_window: float, order: str, vector: str, part: str = PART, similarity=cosine) -> DataFrame:
    """Accepted items with their similarity to the one accepted before (0 for the first).

    Accepted below threshold, or below `rapid` if the last one is less than rapid_window away.
    """

    def step(g: pd.DataFrame) -> list[dict]:
        out, last, at = [], None, 0.0
        for o, v in g.sort_values(order)[[order, vector]].itertuples(index=False):
            v = np.asarray(v, np.float64)
            s = 0.0 if last is None else similarity(last, v)
            limit = max(threshold, rapid) if last is not None and o - at < rapid_window else threshold
            if last is None or s < limit:
                out.append({order: o, "similarity": s})
                last, at = v, o
        return out

    return _fold(df, step, f"{order} {df.schema[order].dataType.simpleString()}, similarity double", part)


def keep_latest(df: DataFrame, threshold: float, order: str, vector: str, part: str = PART, similarity=cosine) -> DataFrame:
    """An item at or above threshold replaces the last accepted one; items without vector stay and are never compared with.

    audio_start of a kept item is the order of the kept one before it, 0 for the first.
    """

    def step(g: pd.DataFrame) -> list[dict]:
        kept: list[tuple] = []
        last = None
        for o, v in g.sort_values(order)[[order, vector]].itertuples(index=False):
            if v is None:
                kept.append((o,))
                continue
            v = np.asarray(v, np.float64)
            if last is not None and similarity(last, v) >= threshold:
                kept.pop()
            kept.append((o,))
            last = v
        return [{order: o, "audio_start": kept[k - 1][0] if k else 0, "index": k + 1} for k, (o,) in enumerate(kept)]

    kind = df.schema[order].dataType.simpleString()
    return _fold(df, step, f"{order} {kind}, audio_start {kind}, index long", part)


def keep_cleaner(df: DataFrame, threshold: float, order: str, vector: str, penalty: str, part: str = PART, similarity=cosine) -> DataFrame:
    """An item at or above threshold replaces the last accepted one only if its penalty is strictly less.

    A replaced item keeps its place and its audio_end; the next item's audio starts there.
    """

    def step(g: pd.DataFrame) -> list[dict]:
        kept: list[dict] = []
        last, last_penalty, end = None, 0.0, 0
        for o, v, p in g.sort_values(order)[[order, vector, penalty]].itertuples(index=False):
            v = np.asarray(v, np.float64)
            if last is not None and similarity(last, v) >= threshold:
                if p < last_penalty:
                    kept[-1][order] = o
                    last, last_penalty = v, p
                continue
            kept.append({order: o, "audio_start": end, "audio_end": o})
            last, last_penalty, end = v, p, o
        return kept

    kind = df.schema[order].dataType.simpleString()
    return _fold(df, step, f"{order} {kind}, audio_start {kind}, audio_end {kind}", part)


def press_keys(df: DataFrame, slides: int, order: str, key: str, part: str = PART) -> DataFrame:
    """(entity, slide, keep) of `slides` slides, numbered from 1 and kept at first, after the keys of df in order.

    y and n mark the slide in hand and go on to the next, u turns its mark, d goes on, a goes
    back, never beyond the ends; s and q end the session; other keys do nothing.
    """

    def step(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        keep, at = np.ones(slides, bool), 0
        for k in values[key]:
            if k in ("s", "q"):
                break
            if k == "u":
                keep[at] = not keep[at]
            elif k in ("y", "n"):
                keep[at] = k == "y"
            at = min(at + 1, slides - 1) if k in ("y", "n", "d") else max(at - 1, 0) if k == "a" else at
        return {"slide": np.arange(1, slides + 1), "keep": keep}

    return fold(df.select(part, order, F.lower(key).alias(key)), part, [order], step, f"{part} {df.schema[part].dataType.simpleString()}, slide long, keep boolean")


def key_session(slides: DataFrame, keys: DataFrame, order: str, vector: str, key: str, threshold: float = 0.9, part: str = PART, similarity=cosine) -> DataFrame:
    """(entity, order, keep, ended): each slide's mark after the entity's keys, and how the session ended.

    Slides stand in their order and are kept at first. y and n mark the slide in hand and go on to the next, u turns its mark, d goes on,
    a goes back, never beyond the ends. r walks over the kept slides that have a vector and takes away each that is at or
    above threshold against the last one it left, if their vectors are of one length. s saves and q quits, which
    gives all marks back; later keys do nothing, nor do others. ended is save, quit or open. Entities without slides have no rows.
    """

    def remove(keep: np.ndarray, vectors: list) -> None:
        last = None
        for k in np.flatnonzero(keep).tolist():
            v = vectors[k]
            if v is None:
                continue
            if last is not None and last.shape == v.shape and similarity(last, v) >= threshold:
                keep[k] = False
            else:
                last = v

    def step(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        is_slide = values["_side"] == 0
        vectors = [None if v is None else np.asarray(v, np.float64) for v in values["_v"][is_slide]]
        keep, at, ended = np.ones(len(vectors), bool), 0, "open"
        for k in values["_k"][~is_slide] if len(vectors) else ():
            if k in ("s", "q"):
                ended = "save" if k == "s" else "quit"
                break
            if k == "r":
                remove(keep, vectors)
            elif k == "u":
                keep[at] = not keep[at]
            elif k in ("y", "n"):
                keep[at] = k == "y"
            at = min(at + 1, len(vectors) - 1) if k in ("y", "n", "d") else max(at - 1, 0) if k == "a" else at
        if ended == "quit":
            keep[:] = True
        return {"_o": values["_o"][is_slide], "keep": keep, "ended": np.full(len(vectors), ended, object)}

    place = F.row_number().over(Window.partitionBy(part).orderBy(order)).cast("long")
    numbered = slides.select(part, F.col(order), place.alias("_o"), F.col(vector).cast("array<double>").alias("_v"))
    sides = numbered.select(part, F.lit(0).alias("_side"), "_o", "_v", F.lit(None).cast("string").alias("_k"))
    pressed = keys.select(part, F.lit(1).alias("_side"), F.col(order).cast("long").alias("_o"), F.lit(None).cast("array<double>").alias("_v"), F.lower(key).alias("_k"))
    kind = slides.schema[part].dataType.simpleString()
    marked = fold(sides.unionByName(pressed), part, ["_side", "_o"], step, f"{part} {kind}, _o long, keep boolean, ended string")
    return numbered.join(marked, [part, "_o"]).select(part, order, "keep", "ended")


def curate(df: DataFrame, threshold: float, order: str, vector: str, part: str = PART, similarity=cosine) -> DataFrame:
    """Items with keep: false at or above threshold against the last kept item of the same shape."""

    def step(g: pd.DataFrame) -> list[dict]:
        out, last = [], None
        for o, v in g.sort_values(order)[[order, vector]].itertuples(index=False):
            v = np.asarray(v, np.float64)
            drop = last is not None and last.shape == v.shape and similarity(last, v) >= threshold
            out.append({order: o, "keep": not drop})
            last = last if drop else v
        return out

    return _fold(df, step, f"{order} {df.schema[order].dataType.simpleString()}, keep boolean", part)
