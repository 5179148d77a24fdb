"""SimHash near-duplicates: fingerprints, pigeonring candidates, connected components.

Fingerprints link at BUDGET or fewer differing bits. Split what two fingerprints may
differ in into a ring of SEGMENTS segments: by the pigeonring principle a linked pair
has a start from which every chain of consecutive segments stays within its proportional
budget, floor(BUDGET * length / SEGMENTS) bits. The first chain has length one and budget
zero, so the start segment is an exact key: equal keys meet in a bucket, the longer
chains prune the pairs there, and only what is left gets the full Hamming check.

A bucket of more than BUCKET distinct fingerprints is not compared but split: its free bits
form a new ring with its own exact keys, again without loss. Each split fixes a quarter of
the free bits, and a bucket with 10 free bits cannot exceed BUCKET, so splitting ends after
a fixed number of levels and no bucket is ever larger. Copies meet before that, as one
distinct fingerprint. A bucket's links leave it as a spanning forest (fewer links than
fingerprints) rather than as pairs; no two linked fingerprints are parted by that. Components come
from alternating large-star and small-star steps. Heavy fingerprints and hubs are salted in joins.

Edge cases: null or blank text has fingerprint zero, linked like any other; texts of one or
two words hash the whole sequence; null doc_ids take part but never name a
component unless all of its ids are null; repeated rows share a component; an
empty table gives an empty result; extra columns pass through keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, durable, fresh, heavy, join_salted, plain_names, slices

BUDGET = 3
SEGMENTS = 4
SHINGLE = 3
BUCKET = 1024
_SEED = 42
_ROWS = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the shingles of lower-cased words (A-Z only, ASCII white space)."""
    tokens = (text or "").encode(errors="surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, _SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    ones = np.zeros(64, np.int64)
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    for at in range(0, n, _ROWS):
        h = np.array([digest(line[a:b], _SEED) for a, b in zip(starts[at : at + _ROWS], stops[at : at + _ROWS], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(ones * 2 > n))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp long")


@cache
def ring(fixed: int) -> tuple[int, ...]:
    """The free bits under the mask fixed, as SEGMENTS masks of consecutive bits."""
    free = [b for b in range(64) if not fixed >> b & 1]
    cuts = [len(free) * k // SEGMENTS for k in range(SEGMENTS + 1)]
    return tuple(sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fixed, start, fp): each row's fingerprint under each start segment of the ring that its fixed mask leaves."""
    for batch in batches:
        prints = batch.column("fp").to_numpy()
        masks = batch.column("fixed").to_numpy()
        for fixed in np.unique(masks):
            own = prints[masks == fixed]
            for start, segment in enumerate(ring(int(fixed) & (2**64 - 1))):
                mask = np.int64(_signed((int(fixed) & (2**64 - 1)) | segment))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), fixed)), pa.array(np.full(len(own), start, np.int32)), pa.array(np.full(len(own), mask)), pa.array(own & mask), pa.array(own)], ["fixed", "start", "mask", "key", "fp"])


def chain_links(prints: np.ndarray, fixed: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within BUDGET among prints that agree under fixed and in segment start."""
    i, j = np.triu_indices(len(prints), 1)
    x = prints[i] ^ prints[j]
    segments = ring(fixed)
    chain = 0
    for length in range(2, SEGMENTS + 1):
        chain |= segments[(start + length - 1) % SEGMENTS]
        keep = np.bitwise_count(x & np.uint64(chain)) <= BUDGET * length // SEGMENTS
        i, j, x = i[keep], j[keep], x[keep]
    keep = np.bitwise_count(x) <= BUDGET
    return i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, each node tied to the first of its tree."""
    parent = list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(v, root(v)) for v in range(n) if root(v) != v]


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = [], []
        for fixed, start, prints in zip(batch.column("fixed").to_pylist(), batch.column("start").to_pylist(), batch.column("prints"), strict=True):
            own = np.sort(prints.values.to_numpy().view(np.uint64))
            for v, r in _forest(len(own), *chain_links(own, fixed & (2**64 - 1), start)):
                left.append(int(own[v].view(np.int64)))
                right.append(int(own[r].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links among distinct fingerprints (column fp) that connect all within BUDGET bits."""
    if bucket < 1 << SEGMENTS:
        raise ValueError(f"bucket must be {1 << SEGMENTS} or more: with fewer free bits than segments nothing is left to split")
    rows = nodes.select(F.lit(0).cast("long").alias("fixed"), "fp")
    found = None
    while True:
        keyed = rows.mapInArrow(_keyed, "fixed long, start int, mask long, key long, fp long")
        keyed = keyed if found is None else durable(keyed)
        at = ["fixed", "start", "mask", "key"]
        sizes = durable(keyed.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1"))
        small = keyed.join(sizes.where(F.col("n") <= bucket).select(*at), at, "left_semi")
        edges = small.groupBy(*at).agg(F.collect_list("fp").alias("prints")).mapInArrow(_link_buckets, "u long, v long").distinct()
        found = edges if found is None else found.unionByName(edges)
        large = sizes.where(F.col("n") > bucket).select(*at)
        if large.isEmpty():
            return durable(found.distinct())
        rows = keyed.join(large, at, "left_semi").select(F.col("mask").alias("fixed"), "fp")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node of its component.

    Large and small stars in turn. The hub of a great star has a row for each leaf: such heavy nodes are salted in the joins.
    """
    edges = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = join_salted(both, least.select("u", "m"), "u", heavy(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_salted(large, down.select("u", "m"), "u", heavy(down, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        after = durable(small.where("u <> v").distinct())
        # a fixed point is a set of stars: no node both points and is pointed at, and none points twice
        points = after.groupBy("u").agg(F.count("*").alias("n"))
        still = points.where("n > 1").isEmpty() and after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        edges = after
        if still:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root), a row per row of docs; root names the component by a fingerprint."""
    prints = durable(fingerprints(docs))
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    trees = components(links(nodes))
    # ids of the linked fingerprints, roots included
    of_root = trees.select("root").distinct().select(F.col("root").alias("node"), "root").unionByName(trees.select("node", "root"))
    named = of_root.join(nodes.select(F.col("fp").alias("node"), "first"), "node")
    ids = named.groupBy("root").agg(F.min("first").alias("id"), F.count("*").alias("n"))
    linked = join_salted(named, ids.select("root", "id"), "root", heavy(ids, "root")).select(F.col("node").alias("fp"), "root", "id")
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("id", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return join_salted(prints, classes, "fp", heavy(nodes, "fp")).select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component (root) of docs: one with the component's id and, of those, the least fingerprint.

    Where an id stands on several rows, or is null, fingerprints tell them apart. Of several rows
    equal in id and fingerprint one stays, any.
    """
    found = durable(near_duplicates(docs.select("doc_id", "text")))
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = durable(own.groupBy("root").agg(F.first("doc_id").alias("doc_id"), F.min("fp").alias("fp")))
    rows = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = durable(chosen.select("doc_id").distinct().join(rows, "doc_id"))
    once = docs.join(ids.where("n = 1"), "doc_id", "left_semi")
    again = docs.join(ids.where("n > 1"), "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    return once.select(*_named(docs)).unionByName(_by_print(again.select(*_named(docs)), chosen))


def _named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _by_print(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of docs for each (doc_id, fp) of chosen that is found there."""
    plain = plain_names(docs, "doc_id", "text")
    mark = fresh(plain, "_fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield batch.append_column(mark, pa.array(prints))

    schema = T.StructType([*plain.schema, T.StructField(mark, T.LongType())])
    printed = plain.mapInArrow(run, schema).dropDuplicates(["doc_id", mark])
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{mark}") == F.col("k.fp"))
    return printed.alias("d").join(chosen.alias("k"), same, "left_semi").select(*plain.columns).toDF(*docs.columns)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
