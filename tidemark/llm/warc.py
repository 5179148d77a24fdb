"""WARC archives of pages and a globally ordered index of their captures.

Writing: pages with equal payloads are found by SHA-256; the one of the smallest page_id is a response, the others
revisit it and hold no payload. Records are whole strings, so Spark's text writer makes gzipped WARC files on any store.
Reading: a task parses whole archives of about ARCHIVE_BYTES, checks each payload against its digest and
gives index entries. Index: the entries of a task, sorted by URL key and time, are a run. Ranges of the
key space bring pieces of many runs together; a loser tree merges them k ways, a range of about RANGE_ROWS entries
at a time. A range is cut by (URL key, time, page_id, place), so one URL may hold any share of the captures. Places and
capture numbers that go on from range to range come from one row per range.

Edge cases: null html is an empty payload; null page_id comes last among equal payloads and sorts first in a history; rows that repeat
the smallest page_id with the same payload are all responses; a null url has no target line and the key ''; control
characters in a url are percent-encoded, as its syntax demands; page_id keeps its type, which casts from string must give
back; extra columns are not read; an empty table gives an empty result. Pages carry no time:
a record's is EPOCH plus page_id (modulo 10^9) seconds, or that of a column of seconds that the caller names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, heavy, join_salted, shared_path

ARCHIVE_BYTES = 1 << 24
RANGE_ROWS = 1 << 16
EPOCH = "2024-01-01 00:00:00"
#: Between records stand two line ends.
END = "\r\n\r\n"
# Version line and revisit profile of the archive format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base 32: 60, 60 and 40 bits of the hexadecimal digits at a time."""
    digits = F.sha1(payload)
    part = lambda at, n: F.lpad(F.conv(F.substring(digits, at, n), 16, 32), n * 4 // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """The url in sorting form: host labels from the last to the first, then path and query; no scheme, user, port, leading www or fragment."""
    shape = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)"
    own = F.coalesce(url, F.lit(""))
    lower = F.translate(F.regexp_extract(own, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.regexp_replace(lower, r"^[^@]*@|:[0-9]*$|^www[0-9]*\.", "")
    path = F.regexp_extract(own, shape, 2)
    named = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    return F.when(own.rlike(shape), named).otherwise(F.regexp_replace(own, "#.*$", ""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(page_id.cast("string"))), F.lit("")), F.lit(">"))


def _encoded(url: Column) -> Column:
    out = url
    for code in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), out).otherwise(url)


def record(page_id: Column, first: Column, url: Column, seconds: Column, payload: Column) -> Column:
    """A record without the line ends behind it: a response, or a revisit of first where that is another page."""
    known = page_id.eqNullSafe(first)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    size = F.octet_length(payload).cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", size), F.lit("\r\n"))
    block = F.concat(head, F.when(known, payload).otherwise(F.lit("")))
    moment = F.timestamp_add("SECOND", seconds, F.lit(EPOCH).cast("timestamp_ntz")).cast("string")
    again = F.concat(line("WARC-Refers-To", _record_id(first)), line("WARC-Profile", F.lit(PROFILE)))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(known, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", _record_id(page_id)),
        line("WARC-Date", F.concat(F.replace(moment, F.lit(" "), F.lit("T")), F.lit("Z"))),
        F.coalesce(line("WARC-Target-URI", _encoded(url)), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), payload_digest(payload))),
        F.when(known, F.lit("")).otherwise(again),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, seconds: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """pages (page_id, url, html) as gzipped archives under path; seconds names a column of seconds after EPOCH.

    A file holds as many records as have archive_bytes of payload on average.
    """
    time = F.col(seconds) if seconds else F.pmod(F.coalesce(F.col("page_id").try_cast("long"), F.lit(0)), F.lit(10**9))
    own = pages.select("page_id", "url", time.cast("int").alias("seconds"), F.coalesce("html", F.lit("")).alias("payload")).withColumn("identity", F.unhex(F.sha2("payload", 256)))
    firsts = durable(own.groupBy("identity").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes")))
    sums = firsts.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    rows = max(1, (sums["n"] or 1) * archive_bytes // max(1, sums["bytes"] or 1))
    known = join_salted(own, firsts.select("identity", "first"), "identity", heavy(firsts, "identity"))
    out = known.select(record(*[F.col(c) for c in ("page_id", "first", "url", "seconds", "payload")]).alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", min(rows, 2**31 - 1)).text(path)


_HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of the records of an archive; ValueError where it is no archive or cut off."""
    at = 0
    while at < len(data):
        body = data.find(b"\r\n\r\n", at) + 4
        if not data.startswith(f"{VERSION}\r\n".encode(), at) or body < 4:
            raise ValueError(f"no record at byte {at}")
        headers = {k.decode(): v.decode() for k, v in _HEADER.findall(data, at + len(VERSION) + 2, body - 2)}
        end = body + int(headers["Content-Length"])
        if data[end : end + 4] != END.encode():
            raise ValueError(f"record at byte {at} is cut off")
        yield at, end + 4 - at, headers, data[body:end]
        at = end + 4


def _page_id(name: str | None) -> str | None:
    return unquote_plus(name[len("<urn:x-page:") : -1]) if name and name.startswith("<urn:x-page:") else None


ENTRY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("file",)]
    + [T.StructField(c, T.LongType()) for c in ("offset", "length")]
    + [T.StructField(c, T.StringType()) for c in ("page_id", "url", "timestamp", "digest", "record_type", "refers_to")]
    + [T.StructField("payload_bytes", T.LongType())]
)
_KINDS = {"string": pa.string(), "bigint": pa.int64()}


def entries(name: str, data: bytes) -> Iterator[tuple]:
    """Index entries of an archive in the order of ENTRY; a payload that does not have its digest is an error."""
    for offset, length, headers, block in parse(data):
        head, _, payload = block.partition(b"\r\n\r\n")
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload at byte {offset} of {name} is damaged")
        size = int(dict(_HEADER.findall(head + b"\r\n"))[b"Content-Length"])
        moment = re.sub("[^0-9]", "", headers["WARC-Date"])
        yield name, offset, length, _page_id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), moment, digest, headers["WARC-Type"], _page_id(headers.get("WARC-Refers-To")), size


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [(f.name, _KINDS[f.dataType.simpleString()]) for f in ENTRY]
    for batch in batches:
        for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
            name = name.as_py().rsplit("/", 1)[-1]
            rows = list(zip(*entries(name, gzip.decompress(content.as_py())), strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(rows, fields, strict=True)], [n for n, _ in fields])


def read_archives(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """The index entries of the archives under path, with page ids of id_type and URL keys, in no order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    found = files.mapInArrow(_entry_rows, ENTRY)
    return found.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type), "url_key": url_key(F.col("url"))})


class LoserTree:
    """Merges sorted runs of keys: inner nodes hold the loser of their match, so that the next winner costs one path to the root."""

    def __init__(self, runs: list[list]):
        self.keys = [[(0, key) for key in run] + [(1,)] for run in runs]
        self.at = [0] * len(runs)
        k = len(runs)
        winners = [0] * k + list(range(k))
        self.losers = [0] * k
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.keys[a][self.at[a]], self.keys[b][self.at[b]]
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator[int]:
        """The run of each next least key."""
        k = len(self.keys)
        for _ in range(sum(map(len, self.keys)) - k):
            run = self.winner
            yield run
            self.at[run] += 1
            node = (run + k) // 2
            while node:
                if self._first(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def merged(table: pa.Table) -> pa.Table:
    """The rows of runs (columns run and n, the place in the run) in order of key, by a loser tree."""
    table = table.sort_by([("run", "ascending"), ("n", "ascending")])
    runs = table.column("run").to_numpy()
    starts = np.flatnonzero(np.diff(runs, prepend=runs[:1] - 1)) if len(runs) else np.zeros(0, np.int64)
    pages = [(i is not None, i if i is not None else 0) for i in table.column("page_id").to_pylist()]
    keys = list(zip(table.column("url_key").to_pylist(), table.column("timestamp").to_pylist(), pages, table.column("digest").to_pylist(), strict=True))
    ends = [*starts[1:].tolist(), len(keys)]
    heads = starts.tolist()
    order = []
    for run in LoserTree([keys[a:b] for a, b in zip(heads, ends, strict=True)]) if len(heads) else ():
        order.append(heads[run])
        heads[run] += 1
    return table.take(pa.array(order, pa.int64()))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = merged(pa.Table.from_batches(held))
    keys = table.column("url_key").to_pylist()
    seq, last = [], None
    for key in keys:
        seq.append(seq[-1] + 1 if key == last else 1)
        last = key
    part = np.full(len(keys), TaskContext.get().partitionId(), np.int64)
    out = table.drop_columns(["run", "n"]).append_column("range", pa.array(part)).append_column("place", pa.array(np.arange(1, len(keys) + 1))).append_column("seq", pa.array(seq, pa.int64()))
    yield from out.to_batches(max_chunksize=1 << 14)


def build_index(found: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The entries of found with position (from 1 over all, by URL key, time, page_id and digest) and capture (from 1 within the URL key), under path."""
    spark = found.sparkSession
    order = ["url_key", "timestamp", "page_id", "digest"]
    number = F.monotonically_increasing_id()
    found.sortWithinPartitions(*order).withColumn("id", number).select("*", F.shiftright("id", 33).alias("run"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("n")).drop("id").write.parquet(f"{path}/runs")
    kind = T.StructType([*found.schema, T.StructField("run", T.LongType()), T.StructField("n", T.LongType())])
    runs = spark.read.schema(kind).parquet(f"{path}/runs")
    ranges = max(1, -(-runs.count() // range_rows))
    schema = T.StructType([*found.schema, *(T.StructField(c, T.LongType()) for c in ("range", "place", "seq"))])
    runs.repartitionByRange(ranges, *order, "file", "offset").mapInArrow(_merge, schema).write.parquet(f"{path}/index")
    index = spark.read.schema(schema).parquet(f"{path}/index")
    at = F.struct("place", "url_key", "seq")
    ends = index.groupBy("range").agg(F.count("*").alias("rows"), F.min(at).alias("a"), F.max(at).alias("z")).select("range", "rows", F.col("a.url_key").alias("first_key"), F.col("z.url_key").alias("last_key"), F.col("z.seq").alias("last_seq"))
    # one row per range: what stands in front of it, and how often its first key did
    all_ranges = Window.orderBy("range")
    so_far = F.sum("last_seq").over(Window.partitionBy("last_key").orderBy("range"))
    carried = ends.withColumn("so_far", so_far).select(
        "range",
        "first_key",
        F.coalesce(F.sum("rows").over(all_ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.when(F.lag("last_key").over(all_ranges) == F.col("first_key"), F.lag("so_far").over(all_ranges)).otherwise(0).alias("before"),
    )
    more = F.when(F.col("url_key") == F.col("first_key"), F.col("before")).otherwise(0)
    return index.join(carried, "range").select(*found.columns, (F.col("start") + F.col("place")).alias("position"), (F.col("seq") + more).alias("capture"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as their archives and the merged index tell of them."""
    pages, path = spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_path(spark, "warc")
    write_archives(pages, f"{path}/archives")
    index = build_index(read_archives(spark, f"{path}/archives", pages.schema["page_id"].dataType), path)
    return index.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url_key", "timestamp", "position", "capture")


_SHAPE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)"
ORACLE_SQL = f"""
WITH own AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload FROM pages),
firsts AS (SELECT payload, min(page_id) AS first FROM own GROUP BY payload),
parts AS (SELECT page_id, first, url, payload, sha1(payload) AS h, regexp_replace(lower(regexp_extract(url, '{_SHAPE}', 1)), '^[^@]*@|:[0-9]*$|^www[0-9]*\\.', '', 'g') AS host,
    regexp_extract(url, '{_SHAPE}', 2) AS path FROM own JOIN firsts USING (payload)),
told AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31))::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to,
    CASE WHEN regexp_matches(url, '{_SHAPE}') THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END ELSE regexp_replace(url, '#.*$', '') END AS url_key,
    strftime(TIMESTAMP '{EPOCH}' + to_seconds(coalesce(page_id, 0) % 1000000000), '%Y%m%d%H%M%S') AS timestamp FROM parts)
SELECT *, row_number() OVER w AS position, row_number() OVER (PARTITION BY url_key ORDER BY timestamp, page_id, payload_digest) AS capture FROM told
WINDOW w AS (ORDER BY url_key, timestamp, page_id NULLS FIRST, payload_digest)
"""
