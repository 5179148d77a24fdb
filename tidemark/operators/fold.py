"""Ordered folds of whole entities over Arrow batches, without a data frame per entity.

One exchange brings an entity's rows together and sorts them; a pass over the partition cuts its
batches at entity borders and hands each entity's columns to a function. An entity in
hand is held in memory, its neighbours are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of results that leave at once.
OUT_ROWS = 20_000


def _entities(batches: Iterator[pa.RecordBatch], part: str, columns: list[str]) -> Iterator[tuple[pa.Scalar, dict[str, np.ndarray]]]:
    """(entity, its columns) of batches sorted by part."""
    key, held = None, []

    def taken() -> dict[str, np.ndarray]:
        return {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in columns}

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = pc.run_end_encode(batch.column(part))
        start = 0
        for end, k in zip(keys.run_ends.to_pylist(), keys.values, strict=True):
            if held and k != key:
                yield key, taken()
                held = []
            key = k
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield key, taken()


def fold(df: DataFrame, part: str, order: list[str], step: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """step over each entity's columns (all but part, rows sorted by order); it returns result columns of one length.

    A window asks for the partitioning and the order: Spark holds it to that, while it drops a repartition() by a key that its input
    is partitioned by and may then, above a union, merge the partitions of either side alone, which parts an entity's rows.
    """
    columns = [c for c in df.columns if c != part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, parts, rows = [], [], [], 0

        def flush() -> pa.RecordBatch:
            made = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            own = pa.array(keys, type=keys[0].type).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
            return pa.RecordBatch.from_arrays([own, *map(pa.array, made.values())], [part, *made])

        for key, values in _entities(batches, part, columns):
            out = step(values)
            n = len(next(iter(out.values())))
            keys.append(key)
            sizes.append(n)
            parts.append(out)
            rows += n
            if rows >= OUT_ROWS:
                yield flush()
                keys, sizes, parts, rows = [], [], [], 0
        if parts:
            yield flush()

    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return df.withColumn("_place", place).mapInArrow(run, schema)
