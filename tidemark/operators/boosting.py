"""Second-order boosted trees from histograms of gradients that Spark sums.

Features are cut into bins once and stored as small integers. A level of a tree is one job over blocks of rows that Spark
keeps between jobs: rows find their node, tasks sum gradients and curvatures by (node, feature, bin), and Spark adds up the
tasks' sums. Of two siblings only the lighter one is summed, the other is the parent less it. What reaches the driver is at most
2^(depth - 1) * features * (bins + 1) sums from each of a few tasks, whatever the number of rows.

Gradients are rounded to whole multiples of 2^-20 before they are summed, so sums do not depend on the order of rows:
the same rows give the same model on any cluster and after lost tasks. Sums hold up to 8 * 10^12 rows of weight one.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch

#: Gradients and curvatures are whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: Trees whose margins are only kept by Spark before they are written beside the rows; a lost block is made again from there.
PENDING = 10
#: Rows for which a task of its own is worth while.
TASK_ROWS = 1 << 15
#: Tasks whose sums the driver adds up itself; those of more tasks are added up in tasks first.
FEW_TASKS = 32


@dataclass(frozen=True)
class Settings:
    """Fixed values of the published training: shape, step, sampling and regularisers."""

    trees: int = 200
    depth: int = 6
    rate: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    least_weight: float = 3.0
    gamma: float = 0.1
    alpha: float = 0.1
    ridge: float = 1.0
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number: 1 is the root, 2n and 2n + 1 the children of n; a node without a feature (-1) is a leaf."""

    feature: list[int]
    cut: list[int]
    missing_left: list[bool]
    gain: list[float]
    value: list[float]

    def depth(self) -> int:
        return len(self.feature).bit_length() - 2

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 << depth
        return Tree([-1] * n, [0] * n, [True] * n, [0.0] * n, [0.0] * n)


@dataclass
class Boosted:
    """A fitted model: edges by feature (a value belongs to the first edge not below it) and trees."""

    features: list[str]
    edges: list[list[float]]
    trees: list[Tree]

    def save(self, spark: SparkSession, path: str) -> None:
        """One text file, written through Spark, so any store will do."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        found = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        return Boosted(found["features"], found["edges"], [Tree(**t) for t in found["trees"]])


def bin_edges(train: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most bins - 1 cuts of each feature at its approximate quantiles, in one pass; nulls and NaN count for nothing."""
    shares = [k / bins for k in range(1, bins)]
    known = lambda c: F.when(~F.isnan(c), c)
    found = train.agg(*[F.percentile_approx(known(F.col(f"`{f}`").cast("double")), shares, 100 * bins).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(q)) if q else [] for q in found]


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The number of edges below each value, -1 for NaN, by feature: (features, rows)."""
    return np.stack([np.where(np.isnan(v), -1, np.searchsorted(e, v)) for v, e in zip(x.T, edges, strict=True)])


def walk(tree: Tree, bins: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after so many levels; a row stops at a leaf."""
    feature, cut, left = np.asarray(tree.feature), np.asarray(tree.cut), np.asarray(tree.missing_left)
    node, at = np.ones(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(levels):
        f = feature[node]
        b = bins[np.maximum(f, 0), at]
        node = np.where(f < 0, node, 2 * node + np.where(b < 0, ~left[node], b > cut[node]))
    return node


def margins(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    """The sum of leaf values over the trees, in their order."""
    out = np.zeros(bins.shape[1])
    for t in trees:
        out += np.asarray(t.value)[walk(t, bins, t.depth())]
    return out


def _split_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bins by feature, margins) of a batch of stored rows."""
    bins = batch.column("b")
    return bins.flatten().to_numpy().reshape(len(bins), -1).T.astype(np.int64), batch.column("m").to_numpy()


@dataclass
class Block:
    """A batch of rows: bins by feature, label, weight, written margin, margin of the pending trees, a bit for each pending tree that draws the row."""

    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    m: np.ndarray
    added: np.ndarray
    drawn: np.ndarray

    def grown(self, tree: Tree) -> Block:
        return replace(self, added=self.added + margins([tree], self.bins))


def _blocks(rows: DataFrame, first: int, widest: int, s: Settings) -> RDD:
    """Blocks of the stored rows (b, y, w, k, m) for the trees from first on, a batch to a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, m = _split_batch(batch)
            y, w, drawn = (batch.column(c).to_numpy() for c in "ywd")
            block = Block(bins.astype(np.int8 if widest < 128 else np.int16), y, w, m, np.zeros(len(m)), drawn)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    bit = lambda i: F.when(_draws(first + i, s), F.lit(1 << i)).otherwise(0).cast("int")
    drawn = sum((bit(i) for i in range(PENDING)), F.lit(0))
    return rows.select("b", "y", "w", "m", drawn.alias("d")).mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r.block))


def _draws(number: int, s: Settings) -> Column:
    """Whether a tree sees a row."""
    return F.lit(True) if s.rows >= 1 else F.pmod(F.xxhash64("k", F.lit(s.seed), F.lit(number)), F.lit(1 << 20)) < int(s.rows * (1 << 20))


def histogram(blocks: RDD, bit: int, tree: Tree, level: int, wanted: list[int], columns: list[int], widest: int) -> np.ndarray:
    """Sums of gradients and curvatures of the logistic loss, in units, by (node of wanted, column, bin + 1, which of both), over the rows drawn by bit."""
    slot = np.full(1 << (level + 1), -1)
    slot[wanted] = np.arange(len(wanted))
    shape = (len(wanted), len(columns), widest + 1)

    def sums(part: Iterator[Block]) -> Iterator[np.ndarray]:
        held = np.zeros((2, int(np.prod(shape))), np.int64)
        for block in part:
            seen = np.flatnonzero(block.drawn >> bit & 1)
            at = slot[walk(tree, block.bins[:, seen], level)]
            seen, at = seen[at >= 0], at[at >= 0]
            p, w = 1 / (1 + np.exp(-(block.m[seen] + block.added[seen]))), block.w[seen]
            g = np.rint((p - block.y[seen]) * w * UNIT)
            h = np.rint(np.maximum(p * (1 - p), 1e-16) * w * UNIT)
            for i, c in enumerate(columns):
                place = (at * shape[1] + i) * shape[2] + block.bins[c, seen] + 1
                for k, x in enumerate((g, h)):  # whole numbers below 2^53 in a batch, so exact
                    held[k] += np.bincount(place, x, held.shape[1]).astype(np.int64)
        yield held

    tasks = blocks.getNumPartitions()
    found = blocks.mapPartitions(sums).treeReduce(np.add, 1 if tasks <= FEW_TASKS else 2) if tasks else np.zeros((2, int(np.prod(shape))), np.int64)
    return np.moveaxis(found.reshape(2, *shape), 0, -1)


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _score(g, h, s: Settings):
    return _shrunk(g, s.alpha) ** 2 / (h + s.ridge)


def _leaf(g: float, h: float, s: Settings) -> float:
    return float(-s.rate * _shrunk(np.float64(g), s.alpha) / (h + s.ridge))


def best_split(sums: np.ndarray, columns: list[int], s: Settings) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, missing go left) of the greatest gain; the first in (feature, cut, left) order of equals.

    sums has (columns, bins + 1, 2) whole units; place 0 of the bins is that of missing values.
    """
    total = sums[0].sum(axis=0)
    whole = total / UNIT
    known = np.cumsum(sums[:, 1:], axis=1)
    found = None
    for missing_left in (True, False):
        left = known + sums[:, :1] if missing_left else known
        right = total - left
        left, right = left / UNIT, right / UNIT
        gain = _score(left[..., 0], left[..., 1], s) + _score(right[..., 0], right[..., 1], s) - _score(whole[0], whole[1], s)
        gain[(left[..., 1] < s.least_weight) | (right[..., 1] < s.least_weight)] = -np.inf
        i, cut = np.unravel_index(np.argmax(gain), gain.shape)
        key = (-gain[i, cut], columns[i], int(cut), not missing_left)
        if found is None or key < found:
            found = key
    gain, feature, cut, right_side = found
    return (float(-gain), feature, cut, not right_side) if -gain > 1e-6 else None


def _pruned(tree: Tree, sums: dict[int, np.ndarray], s: Settings) -> Tree:
    """Splits of too little gain undone from the leaves up, then leaves valued by their sums."""
    for n in range(len(tree.feature) // 2 - 1, 0, -1):
        if tree.feature[n] >= 0 and tree.gain[n] < s.gamma and tree.feature[2 * n] < 0 and tree.feature[2 * n + 1] < 0:
            tree.feature[n] = -1
    for n, (g, h) in sums.items():
        if tree.feature[n] < 0:
            tree.value[n] = _leaf(g / UNIT, h / UNIT, s)
    return tree


def grow(blocks: RDD, bit: int, columns: list[int], widest: int, s: Settings) -> Tree:
    """One tree over the rows that it draws, level by level."""
    tree = Tree.empty(s.depth)
    place = {f: i for i, f in enumerate(columns)}
    totals, above = {}, {}
    wanted, derived = [1], {}
    for level in range(s.depth):
        here = dict(zip(wanted, histogram(blocks, bit, tree, level, wanted, columns, widest), strict=True))
        here |= {n: above[n // 2] - here[other] for n, other in derived.items()}
        wanted, derived = [], {}
        for n in sorted(here):
            totals.setdefault(n, here[n][0].sum(axis=0))
            split = best_split(here[n], columns, s)
            if split is None:
                continue
            tree.gain[n], tree.feature[n], tree.cut[n], tree.missing_left[n] = split
            known, lost = here[n][place[split[1]], 1 : split[2] + 2].sum(axis=0), here[n][place[split[1]], 0]
            totals[2 * n] = known + lost if split[3] else known
            totals[2 * n + 1] = totals[n] - totals[2 * n]
            light, other = (2 * n, 2 * n + 1) if totals[2 * n][1] <= totals[2 * n + 1][1] else (2 * n + 1, 2 * n)
            wanted.append(light)
            derived[other] = light
        above = here
        if not wanted:
            break
    return _pruned(tree, totals, s)


def fit(train: DataFrame, features: list[str], label: str = "label", settings: Settings | None = None, edges: list[list[float]] | None = None, key: list[str] | None = None) -> Boosted:
    """Trees on the logistic loss, margins from 0; rows of label 1 weigh as much in all as those of label 0.

    Null and NaN features are missing: each split learns the side they go to. Rows with a null label are left out. A tree
    sees the rows whose hash of (key, seed, tree) falls within the rate; key names columns that tell rows apart, else features
    and label do, and equal rows are then drawn together. edges gives the cuts, else quantiles do. Without rows, or
    with one label alone, or no usable feature the trees are leaves.
    """
    s, spark = settings or Settings(), train.sparkSession
    if not features:
        raise ValueError("no features")
    train = train.where(F.col(f"`{label}`").isNotNull())
    edges = edges if edges is not None else bin_edges(train, features, s.bins)
    widest = max(map(len, edges)) + 1
    y = F.col(f"`{label}`").cast("double")
    sums = train.agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"), F.count("*").alias("n")).first()
    weight = sums["n0"] / sums["n1"] if sums["n1"] else 1.0
    named = [F.col(f"`{c}`") for c in key or [*features, label]]

    @F.pandas_udf("array<smallint>")
    def bins(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list(binned(x.to_numpy(np.float64), edges).T.astype(np.int16)))

    rows = train.select(bins(_given(features)).alias("b"), y.alias("y"), F.when(y == 1, float(weight)).otherwise(1.0).alias("w"), F.xxhash64(*named).alias("k"), F.lit(0.0).alias("m"))
    tasks = 1 + sums["n"] // TASK_ROWS
    rows = _stored(spark, rows, tasks)
    model, blocks = Boosted(list(features), edges, []), None
    drawn = np.random.default_rng(s.seed)
    for number in range(s.trees):
        bit = number % PENDING
        if number and not bit:
            rows = _stored(spark, _with_margins(rows, model.trees[-PENDING:]), tasks)
        columns = sorted(drawn.choice(len(features), max(1, int(s.columns * len(features))), replace=False).tolist())
        held, blocks = blocks, _grown(blocks, model.trees[-1]) if bit else _blocks(rows, number, widest, s)
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        model.trees.append(grow(blocks, bit, columns, widest, s))
        if held is not None:
            held.unpersist()
    if blocks is not None:
        blocks.unpersist()
    return model


def _grown(blocks: RDD, tree: Tree) -> RDD:
    return blocks.map(lambda b: b.grown(tree))


def _given(features: list[str]) -> Column:
    return F.struct(*[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)])


def _with_margins(rows: DataFrame, pending: list[Tree]) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, m = _split_batch(batch)
            yield batch.set_column(batch.schema.get_field_index("m"), "m", pa.array(m + margins(pending, bins)))

    return rows.mapInArrow(add, rows.schema)


def _stored(spark: SparkSession, rows: DataFrame, tasks: int) -> DataFrame:
    """rows, written by so many tasks at most."""
    path = scratch(spark, "boosting")
    rows.coalesce(tasks).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def predict(model: Boosted, df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """df with probability and prediction (probability at or above threshold), by batches of rows."""

    @F.pandas_udf("double")
    def probability(x: pd.DataFrame) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-margins(model.trees, binned(x.to_numpy(np.float64), model.edges)))))

    scored = df.withColumn("probability", probability(_given(model.features)))
    return scored.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))


def importances(spark: SparkSession, model: Boosted, top: int = 15) -> DataFrame:
    """(rank, feature, importance): the mean gain of a feature's splits, as a share of all features' means."""
    gains = [[g for t in model.trees for f, g in zip(t.feature, t.gain, strict=True) if f == i] for i in range(len(model.features))]
    means = [sum(g) / len(g) if g else 0.0 for g in gains]
    whole = sum(means) or 1.0
    df = spark.createDataFrame([(f, m / whole) for f, m in zip(model.features, means, strict=True)], "feature string, importance double")
    w = Window.orderBy(F.desc("importance"), "feature")  # a row per feature
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("rank", "feature", "importance")
