"""Token-id output in Simple-8b: word-aligned packing with escapes and block offsets.

Each 64-bit word has a 4-bit selector and as many ids as fit into 60 bits at one width. A
value of 60 bits or more is escaped: selector 0, the value in the word after. A document's words
stand alone (its last word may be part filled; its id count tells), so documents pack where
they are read, travel packed, and are never packed twice.

A file is a run of blocks. A block has a header (magic, documents, words, ids), then per
document its id, a validity flag, its id count and the offset of its first word, then all words;
any document decodes without those before it, and all of a block's words decode in one
vectorised pass per selector. Files hold ascending ranges of doc_id, null first. Spark writes each
block as one binary row of a Parquet file, the container that every store offers
to executors; the rows in order of (file, block) are the byte stream, which
export_files() puts into plain files.

Ranges come from counts of doc_id alone. There are as many files as documents need, with 8 bytes
of bounds for each: FILE_ROWS is to grow with the corpus, say to 2**16 at 100 TB. Texts are read
once, and one exchange, a partition per file, carries packed ids. The rows of a hot id are dealt over
all files that it bounds. Edge cases: null and empty texts hold the end id only; rows that share a
doc_id keep all their entries, in each file shorter first; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import documents, shared_path, slices

END_ID = 2
# Fixed values: (values, bits) of selectors 1 to 14 of Simple-8b; selector 0 escapes.
WIDTHS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
MAGIC = b"S8B1"
_HEADER = struct.Struct("<4sIQQ")
BLOCK_IDS = 1 << 16
FILE_ROWS = 8192
#: Texts that are encoded at once.
SLICE_ROWS = 10_000
SLICE_BYTES = 1 << 25
#: Stands for a null doc_id, which comes first.
LOWEST = -(1 << 63)
_PAD = WIDTHS[0][0]
_POWERS = np.uint64(1) << np.arange(61, dtype=np.uint64)
_COUNTS = np.array([1, *(c for c, _ in WIDTHS)], np.int64)


def _selectors(flat: np.ndarray) -> np.ndarray:
    """For each position the first selector, from many values to few, whose width holds all values from there on; 0 escapes.

    Widths grow as counts fall, so a selector that fits makes all after it fit, and failures count the selector.
    """
    width = np.searchsorted(_POWERS[: int(flat.max(initial=0)).bit_length() + 1], flat, side="right").astype(np.uint8)
    # most[c]: greatest width within c values, beyond the end none; two overlapping windows make each longer one
    most = {1: width}
    for count in sorted(c for c, _ in WIDTHS if c > 1):
        c = max(most)
        while c < count:
            grown = min(2 * c, count)
            wider = most[c].copy()
            np.maximum(wider[: c - grown or None], most[c][grown - c :], out=wider[: c - grown or None])
            most[grown] = wider
            c = grown
    selector = np.ones(len(flat), np.uint8)
    for count, bits in WIDTHS:
        selector += most[count] > bits
    selector[selector > len(WIDTHS)] = 0
    return selector


def pack_many(rows: list[np.ndarray]) -> list[np.ndarray]:
    """The words (uint64) of each array of values, all arrays in one vectorised pass."""
    n = np.array([len(r) for r in rows], np.int64)
    begin = np.concatenate(([0], np.cumsum(n + _PAD)))[:-1]
    flat = np.zeros(int((n + _PAD).sum()), np.uint64)
    for b, r in zip(begin.tolist(), rows, strict=True):
        flat[b : b + len(r)] = r
    selector = _selectors(flat)
    step = _COUNTS[selector].astype(np.uint8).tobytes()
    starts: list[int] = []
    ends = []
    for b, m in zip(begin.tolist(), n.tolist(), strict=True):
        at, stop = b, b + m
        while at < stop:
            starts.append(at)
            at += step[at]
        ends.append(len(starts))
    at = np.array(starts, np.int64)
    chosen = selector[at]
    words = np.zeros(len(at), np.uint64)
    padded = np.concatenate((flat, np.zeros(_PAD, np.uint64)))
    for k, (count, bits) in enumerate(WIDTHS, 1):
        own = np.flatnonzero(chosen == k)
        if len(own):
            values = padded[at[own][:, None] + np.arange(count)]
            words[own] = np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1) | np.uint64(k << 60)
    escaped = np.flatnonzero(chosen == 0)
    out = []
    for first, last in zip([0, *ends], ends, strict=False):
        part = words[first:last]
        if len(escaped):
            here = escaped[(escaped >= first) & (escaped < last)]
            part = np.insert(part, here - first + 1, flat[at[here]])
        out.append(part)
    return out


def unpack_many(words: np.ndarray, offsets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All values (uint64) of rows that start at the word offsets and hold n values each."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == 0).any():  # a raw word may look like any selector: walk past the escapes
        keep, raw, at = [], {}, 0
        listed = selector.tolist()
        while at < len(listed):
            keep.append(at)
            if listed[at] == 0:
                raw[len(keep) - 1] = words[at + 1]
                at += 1
            at += 1
        kept = np.array(keep, np.int64)
        offsets = np.searchsorted(kept, offsets)
        words, selector = words[kept], selector[kept]
    else:
        raw = {}
    count = _COUNTS[selector]
    begin = np.cumsum(n) - n
    full = np.cumsum(count) - count
    row = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    # rows without words share an offset with the next; the last such row owns the words
    position = begin[row] + full - full[np.minimum(offsets[row], max(len(words) - 1, 0))]
    room = np.minimum(count, begin[row] + n[row] - position)
    out = np.zeros(int(n.sum()), np.uint64)
    for k, (c, bits) in enumerate(WIDTHS, 1):
        own = np.flatnonzero(selector == k)
        if len(own):
            values = (words[own][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            ok = np.arange(c) < room[own][:, None]
            out[(position[own][:, None] + np.arange(c))[ok]] = values[ok]
    for k, value in raw.items():
        out[position[k]] = value
    return out


def encode_block(ids: list[int | None], counts: list[int], packed: list[bytes]) -> bytes:
    words = np.array([len(p) // 8 for p in packed], "<i8")
    return b"".join(
        [
            _HEADER.pack(MAGIC, len(ids), int(words.sum()), sum(counts)),
            np.array([i or 0 for i in ids], "<i8").tobytes(),
            np.array([i is not None for i in ids], "u1").tobytes(),
            np.array(counts, "<i8").tobytes(),
            (np.cumsum(words) - words).astype("<i8").tobytes(),
            *packed,
        ]
    )


def decode_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, id counts, all ids as <u4) of a block."""
    magic, docs, n_words, _ = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b block")
    at = _HEADER.size
    ids = np.frombuffer(data, "<i8", docs, at)
    valid = np.frombuffer(data, "u1", docs, at + 8 * docs)
    counts = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    offsets = np.frombuffer(data, "<i8", docs, at + 17 * docs)
    words = np.frombuffer(data, "<u8", n_words, at + 25 * docs)
    return [i if v else None for i, v in zip(ids.tolist(), valid.tolist(), strict=True)], counts, unpack_many(words, offsets, counts).astype("<u4")


def _bounds(ids: DataFrame, file_rows: int) -> list[int]:
    """Sorted doc_ids (null as LOWEST) that bound the files, file_rows rows apart or a little less; a hot id bounds several.

    Ids are counted first, so that a hot one is one row; counts are then sorted by range and passed over once per range.
    """
    counts = ids.groupBy(F.coalesce("doc_id", F.lit(LOWEST)).alias("i")).agg(F.count("*").alias("n"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            total = seen + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("i").to_numpy(), total // file_rows - (total - n) // file_rows))], ["i"])
            seen = int(total[-1]) if len(total) else seen

    return sorted(r["i"] for r in counts.repartitionByRange("i").sortWithinPartitions("i").mapInArrow(pick, "i long").collect())


def _encode(path: str, bounds: list[int]):
    limits = np.array(bounds, np.int64)
    end = np.array([END_ID], np.uint32)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small batches, of one row if texts are long."""
        for batch in slices(batches, SLICE_ROWS):  # many at once, as texts share words
            reached = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(reached)) + 1):
                yield batch.slice(part[0], len(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_many
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in pieces(batches):
            ids = pc.fill_null(batch.column("doc_id").cast(pa.int64()), LOWEST).to_numpy(zero_copy_only=False)
            # rows of an id that bounds several files are dealt over these
            first, last = np.searchsorted(limits, ids, "left"), np.searchsorted(limits, ids, "right")
            file = first + (rng.random(len(ids)) * (last - first + 1)).astype(np.int64)
            at = 0
            for flat, counts in encode(batch.column("text")):
                ends = np.cumsum(counts).tolist()
                packed = pack_many([np.concatenate((flat[b - n : b], end)) for b, n in zip(ends, counts.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file[at : at + len(ends)], pa.int32()), batch.column("doc_id").slice(at, len(ends)), pa.array(counts + 1), pa.array([w.astype("<u8").tobytes() for w in packed], pa.binary())],
                    ["file", "doc_id", "n_tokens", "packed"],
                )
                at += len(ends)

    return run


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by file and doc_id as blocks of about BLOCK_IDS ids."""
    file, block, ids, counts, packed, held = None, 0, [], [], [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()), pa.array([encode_block(ids, counts, packed)], pa.binary())], ["file", "block", "n_ids", "data"])

    for batch in batches:
        for f, i, n, p in zip(*(batch.column(c).to_pylist() for c in ("file", "doc_id", "n_tokens", "packed")), strict=True):
            if ids and (f != file or held >= BLOCK_IDS):
                yield flush()
                block = block + 1 if f == file else 0
                ids, counts, packed, held = [], [], [], 0
            file = f
            ids.append(i)
            counts.append(n)
            packed.append(p)
            held += n
    if ids:
        yield flush()


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, file_rows: int = FILE_ROWS) -> None:
    """The token files of docs (doc_id, text) under path, each of about file_rows documents and made by one task."""
    bounds = _bounds(docs.select("doc_id"), file_rows)
    encoded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(vocabulary or default_path(), bounds), "file int, doc_id long, n_tokens long, packed binary")
    filed = encoded.repartitionById(len(bounds) + 1, F.col("file")).sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "n_tokens", "packed")
    filed.mapInArrow(_to_blocks, "file int, block int, n_ids long, data binary").write.option("compression", "zstd").parquet(path)


def _from_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for f, b, data in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("data"), strict=True):
            ids, counts, flat = decode_block(data.as_buffer().to_pybytes())
            before = np.cumsum(counts) - counts
            crc = [zlib.crc32(flat[s : s + n].tobytes()) for s, n in zip(before.tolist(), counts.tolist(), strict=True)]
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([f] * k, pa.int32()), pa.array([b] * k, pa.int32()), pa.array(ids, pa.int64()), pa.array(before), pa.array(counts), pa.array(crc, pa.int64())], ["file", "block", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of token files; start counts the ids of all documents before."""
    blocks = spark.read.parquet(path)
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", before(Window.orderBy("file"), "n").alias("file_start"))
    starts = blocks.select("file", "block", before(Window.partitionBy("file").orderBy("block"), "n_ids").alias("block_start")).join(files, "file")
    rows = blocks.select("file", "block", "data").mapInArrow(_from_blocks, "file int, block int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["file", "block"]).select("doc_id", (F.col("file_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def export_files(spark: SparkSession, path: str, folder: str) -> None:
    """Plain files, one per range of doc_id, block after block; for one machine's use."""
    for r in spark.read.parquet(path).select("file", "block", "data").orderBy("file", "block").toLocalIterator():
        with open(f"{folder}/{r['file']:05d}.s8b", "ab") as out:
            out.write(bytes(r["data"]))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-ids")
    write_ids(documents(spark, sf_dir), path)
    return read_ids(spark, path)
