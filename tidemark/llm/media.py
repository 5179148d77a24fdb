"""Media columns: content-defined chunking, chunk deduplication, verified reconstruction.

A text's UTF-8 bytes, zero-padded to a positive multiple of BLOCK, are its payload of 8-bit
samples. A gear hash rolls over the payload; a cut falls where its top CUT_BITS bits
are zero, within [LEAST, MOST] bytes of the last cut. Each media row stores an ordered list of
chunk digests and lengths (its recipe). A chunk's bytes are stored once: in the row
itself if its digest occurs once in the table, else in the chunk pool, which has a row per digest.

Digests are counted in Spark without their bytes. The repeated ones reach the writers as a Bloom filter
with BITS bits for each, at most MOST_WORDS longs, collected after a distributed bit_or. What the filter names is
deduplicated by digest in Spark before the pool is written. A false positive merely moves a chunk from its row to
the pool: beyond MOST_WORDS the filter costs bytes that travel, never a second copy nor a wrong result.
Reading back, rows without pooled chunks rebuild on the spot; the
other recipes, each once however many rows share it, join the pool by digest and gather their
chunks in order. Both joins salt heavy keys. Every chunk's digest is verified before use.

Edge cases: null and empty texts are BLOCK zero bytes; repeated rows and equal texts share all chunks
and have equal values; null doc_ids are kept; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, heavy, join_salted, shared_path, slices

BLOCK = 64
CUT_BITS = 10
LEAST, MOST = 256, 4096
WINDOW = 32
#: Bits of the filter for each repeated digest, and its most longs (8 MB).
BITS = 16
MOST_WORDS = 1 << 20
FILTER_HASHES = 4
_ENTRY = struct.Struct("<16sI")
#: The gear of each byte: the first 8 bytes of its digest.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode(errors="surrogatepass")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:  # h[i] = sum of gear[i - k] << k over the window, by doubling
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    marks = (np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1).tolist()
    out, at, n = [], 0, len(data)
    for mark in [*marks, n]:
        while mark - at > MOST:
            at += MOST
            out.append(at)
        if mark > at and (mark - at >= LEAST or mark == n):
            at = mark
            out.append(at)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunked(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks of data in order."""
    ends = cuts(data)
    return [(digest(c), c) for c in (data[a:b] for a, b in zip([0, *ends], ends, strict=False))]


def recipe_of(pieces: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join([_ENTRY.pack(d, len(c)) for d, c in pieces])


def _positions(d: bytes, bits: int) -> list[int]:
    return [int.from_bytes(d[4 * k : 4 * k + 4], "little") % bits for k in range(FILTER_HASHES)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = [d for t in batch.column("text").to_pylist() for d, _ in chunked(payload(t))]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["digest"])


def _filter_bits(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([p for d in batch.column("digest").to_pylist() for p in _positions(d, 64 * words)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // 64), pa.array((np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    return run


def repeated_filter(docs: DataFrame) -> bytes:
    """The Bloom filter of digests that occur more than once in docs."""
    counts = docs.select("text").mapInArrow(_digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n"))
    repeated = durable(counts.where("n > 1").select("digest"))
    words = min(MOST_WORDS, 1 << max(6, (repeated.count() * BITS // 64).bit_length()))
    filled = repeated.mapInArrow(_filter_bits(words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MOST_WORDS rows
    out = np.zeros(words, np.int64)
    out[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    return out.tobytes()


def _parted(batches: Iterator[pa.RecordBatch], bloom: bytes) -> Iterator[list[tuple]]:
    """For each small batch its (doc_id, text, [(digest, chunk, whether it belongs to the pool)])."""
    filled = np.frombuffer(bloom, np.uint64).tolist()
    bits = 64 * len(filled)
    for batch in slices(batches):
        rows = []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            rows.append((i, text, [(d, c, all(filled[p >> 6] >> (p & 63) & 1 for p in _positions(d, bits))) for d, c in chunked(payload(text))]))
        yield rows


def _media_rows(bloom: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parted in _parted(batches, bloom):
            rows = []
            for i, text, pieces in parted:
                name = recipe_of([(d, c) for d, c, _ in pieces])
                rows.append((i, len((text or "").encode(errors="surrogatepass")), digest(name), name, b"".join([c for _, c, pooled in pieces if not pooled]), sum(pooled for *_, pooled in pieces)))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "recipe", "name", "data", "pooled"])

    return run


def _pool_rows(bloom: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parted in _parted(batches, bloom):
            chunks = {d: c for _, _, pieces in parted for d, c, pooled in pieces if pooled}
            yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.binary()), pa.array(list(chunks.values()), pa.binary())], ["digest", "data"])

    return run


_MEDIA = "doc_id long, n_bytes long, recipe binary, name binary, data binary, pooled int"
_POOL = "digest binary, data binary"


def store(docs: DataFrame, path: str) -> None:
    """docs (doc_id, text) as media rows and a pool with a row per digest, under path."""
    bloom = repeated_filter(docs)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    docs.mapInArrow(_media_rows(bloom), _MEDIA).write.option("compression", "zstd").parquet(f"{path}/media")
    pool = docs.mapInArrow(_pool_rows(bloom), _POOL).groupBy("digest").agg(F.first("data").alias("data"))
    pool.write.option("compression", "zstd").parquet(f"{path}/pool")


def _entries(recipe: bytes) -> list[tuple[bytes, int]]:
    return list(_ENTRY.iter_unpack(recipe))


def rebuild(recipe: bytes, own: bytes, pool: dict[bytes, bytes]) -> bytes:
    """The payload of a recipe; ValueError where a chunk is missing or damaged."""
    out, at = [], 0
    for d, n in _entries(recipe):
        chunk = pool.get(d)
        if chunk is None:
            chunk = own[at : at + n]
            at += n
        if len(chunk) != n or digest(chunk) != d:
            raise ValueError(f"chunk {d.hex()} is missing or damaged")
        out.append(chunk)
    if at != len(own):
        raise ValueError("bytes that no recipe names")
    return b"".join(out)


def describe(recipe: bytes, own: bytes, data: bytes) -> tuple[int, str, int, int, str, str]:
    """(payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): the stored form is the row's recipe and own bytes."""
    bins = np.bincount(np.frombuffer(data, np.uint8) >> 4, minlength=16)
    stored = recipe + own
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(recipe) // _ENTRY.size}|" + "-".join(map(str, bins.tolist()))


_MADE = [("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]
_MADE_SQL = ", ".join(f"{n} {k}" for n, _, k in _MADE)


def _described(key: str, foreign: bool):
    """Rebuild and describe rows (name, data and, if foreign, chunks); key is carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            chunks = batch.column("chunks").to_pylist() if foreign else [[]] * batch.num_rows
            rows = []
            for recipe, own, pooled in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), chunks, strict=True):
                rows.append(describe(recipe, own, rebuild(recipe, own, {c["digest"]: c["data"] for c in pooled})))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_MADE)
            carried = [batch.column(c) for c in key.split()]
            yield pa.RecordBatch.from_arrays([*carried, *(pa.array(c, k) for c, (_, k, _) in zip(columns, _MADE, strict=True))], [*key.split(), *(n for n, _, _ in _MADE)])

    return run


def _pool_refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r, d) for r, n in zip(batch.column("recipe").to_pylist(), batch.column("name").to_pylist(), strict=True) for d in dict.fromkeys(d for d, _ in _entries(n))]
        recipes, digests = zip(*rows, strict=True) if rows else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(recipes, pa.binary()), pa.array(digests, pa.binary())], ["recipe", "digest"])


def load(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_bytes, ...) of all media rows under path, rebuilt from what is stored."""
    media = spark.read.schema(_MEDIA).parquet(f"{path}/media")
    pool = spark.read.schema(_POOL).parquet(f"{path}/pool")
    alone = media.where("pooled = 0").select("doc_id", "n_bytes", "name", "data").mapInArrow(_described("doc_id n_bytes", False), f"doc_id long, n_bytes long, {_MADE_SQL}")
    shared = media.where("pooled > 0")
    recipes = shared.groupBy("recipe").agg(F.first("name").alias("name"), F.first("data").alias("data"))
    refs = durable(shared.groupBy("recipe").agg(F.first("name").alias("name")).mapInArrow(_pool_refs, "recipe binary, digest binary"))
    often = heavy(refs.groupBy("digest").agg(F.count("*").alias("n")), "digest")
    gathered = join_salted(refs, pool, "digest", often).groupBy("recipe").agg(F.collect_list(F.struct("digest", "data")).alias("chunks"))
    described = recipes.join(gathered, "recipe").mapInArrow(_described("recipe", True), f"recipe binary, {_MADE_SQL}")
    copied = heavy(shared.groupBy("recipe").agg(F.count("*").alias("n")), "recipe")
    joined = join_salted(shared.select("doc_id", "n_bytes", "recipe"), described, "recipe", copied).drop("recipe")
    return alone.unionByName(joined)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "media")
    store(documents(spark, sf_dir), path)
    return load(spark, path)
