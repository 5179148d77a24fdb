"""Outside models as columns: recognisers, transcribers and writers plug in as plain functions.

A model is built once per task by its factory and called per row inside an Arrow batch; a call
that fails gives the fallback, so that one bad input costs one row. The failure is logged, and stands in the
field error of struct results (null where the call went well).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

_log = logging.getLogger(__name__)

RECOGNISED = "struct<text string, confidence double, blocks array<struct<text string, confidence double, y_position double>>, error string>"
SPOKEN = "struct<language string, full_text string, segments array<struct<start double, `end` double, text string>>, error string>"


def _guarded(factory: Callable[[], Callable], kind: str, fallback: Callable):
    def run(batches):
        model = factory()
        for values in batches:
            rows = []
            for v in values:
                try:
                    row, error = model(v), None
                except Exception as failure:  # whatever an outside model raises
                    row, error = fallback(v), f"{type(failure).__name__}: {failure}"
                    _log.warning("outside model failed: %s", error)
                rows.append(row if kind == "string" else {**row, "error": error})
            yield pd.Series(rows, dtype="object") if kind == "string" else pd.DataFrame(rows)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series if kind == "string" else pd.DataFrame]}
    return F.pandas_udf(run, kind)


def recognise(factory: Callable[[], Callable[[bytes], dict]]):
    """Column of images -> RECOGNISED; a failed call is an empty text of confidence 0."""
    return _guarded(factory, RECOGNISED, lambda v: {"text": "", "confidence": 0.0, "blocks": []})


def transcribe(factory: Callable[[], Callable[[bytes], dict]]):
    """Column of audio -> SPOKEN; a failed call has no segments."""
    return _guarded(factory, SPOKEN, lambda v: {"language": "unknown", "full_text": "", "segments": []})


def write_notes(factory: Callable[[], Callable[[str], str]]):
    """Column of prompts -> text; a failed call returns its prompt's first line after a mark."""
    return _guarded(factory, "string", lambda p: "stub: " + (p or "").split("\n")[0])


def python_round(digits: int):
    """Rounding of the exact binary value, ties to even, as documents print numbers."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else round(float(v), digits) for v in x], dtype="float64")

    return run
