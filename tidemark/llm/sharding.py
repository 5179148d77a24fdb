"""Sharding by a two-pass external shuffle, native DataFrame operations only.

Pass one scatters rows into memory-sized buckets by seeded hashes, pass two runs
Fisher-Yates on each bucket. The shuffled buckets, one after another, are a permutation of
all rows; position p goes to shard p mod n at slot p div n, so that counts differ by
one at most (law "rows") and slots have no gap.

write_shards() scatters whole rows by a seeded hash of the place where they are stored (file name and
row number), so texts move once, equal rows spread over all buckets, and what is planned before is read without
texts. A bucket holds about BUCKET_ROWS rows whatever the input's size, a few MB of text. plan_shards() plans rows that
are not stored, by (doc_id, size, crc, occurrence): equal rows are first counted together
(partial sums on the map side, so a hot key costs a row per task and salt) and then numbered in salted
chunks, hence even a key with a third of all rows spreads over all buckets.

Edge cases: null text has 8 bytes and crc 0; null doc_ids are ordinary keys; repeated
rows get a place each; extra columns are carried by write_shards() and may bear any name but shard
and slot, which raise ValueError; an empty table gives an empty plan and no shard. A plan depends on rows, seed and shard
count only, not on how the input is partitioned; that of stored rows also on their files, not on where these lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, durable, let, shared_path

SHARDS = 24
BUCKET_ROWS = 1024
#: Rows of the buckets that one task shuffles and writes.
TASK_ROWS = 8192
#: Copies or buckets that are counted off at once, and salts of a key.
BLOCK = 4096
SEED = 20_240_611
#: Bytes beside the text that a record takes in a shard file.
HEADER = 8
_DRAWN_ID = "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def record_columns(text: Column) -> dict[str, Column]:
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return {"size": F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + HEADER, "text_crc32": F.crc32(raw)}


def fisher_yates(n: Column, draw) -> Column:
    """A random permutation of 1 to n as an array of int: draw(k) in [0, 1) picks the k-th element among those left.

    The picked element leaves the array, the last of those left takes its place, and it stands next in the result.
    """
    start = F.struct(F.sequence(F.lit(1), F.greatest(n, F.lit(1))).alias("left"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, k: Column) -> Column:
        many = F.size(a["left"])

        def pick(at: Column) -> Column:
            # elements before the picked one, the last one in its place, elements behind it but the last
            moved = F.concat(F.slice(a["left"], 1, at), F.slice(a["left"], -1, F.when(at < many - 1, 1).otherwise(0)), F.slice(a["left"], at + 2, F.greatest(many - at - 2, F.lit(0))))
            return F.struct(moved.alias("left"), F.array_append(a["out"], F.get(a["left"], at)).alias("out"))

        return let(F.least((draw(k) * many).cast("int"), many - 1), pick)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step, lambda a: a["out"])).otherwise(F.array().cast("array<int>"))


def _inverse(order: Column) -> Column:
    """places[v] of each value v of a permutation of 1 to n, itself from 1."""
    return F.transform(F.array_sort(F.transform(order, lambda v, i: F.struct(v.alias("v"), (i + 1).alias("i")))), lambda x: x["i"])


def _each(counted: DataFrame) -> DataFrame:
    """A row per copy of counted (doc_id, size, text_crc32, copies), numbered by occurrence, blocks of copies apart."""
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK)))
    return (
        counted.select("doc_id", "size", "text_crc32", "copies", chunks.alias("chunk"))
        .withColumn("occurrence", F.explode(F.sequence(F.col("chunk") * BLOCK, F.least(F.col("copies"), (F.col("chunk") + 1) * BLOCK) - 1)))
        .drop("copies", "chunk")
    )


def _bucket(key: Column, n: int) -> Column:
    """The bucket, of as many as n rows need, that a hashed key falls into."""
    return F.pmod(key, F.lit(max(1, -(-n // BUCKET_ROWS))))


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32", "occurrence")


def _draw(seed: int):
    return lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("bucket"), k), 11).cast("double") * F.lit(2.0**-53)


def _starts(sizes: DataFrame) -> DataFrame:
    """(bucket, n, start) for (bucket, n): sums within groups of buckets, then over groups."""
    sizes = sizes.select("bucket", "n", F.floor(F.col("bucket") / BLOCK).alias("g"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    groups = sizes.groupBy("g").agg(F.sum("n").alias("n")).select("g", before(Window.orderBy("g")).alias("g_start"))
    return sizes.withColumn("b_start", before(Window.partitionBy("g").orderBy("bucket"))).join(groups, "g").select("bucket", "n", (F.col("g_start") + F.col("b_start")).alias("start"))


def _place(position: Column, shards: int) -> list[Column]:
    return [F.pmod(position, F.lit(shards)).cast("int").alias("shard"), F.floor(position / shards).alias("slot")]


def place_key(seed: int) -> Column:
    """A hash of where a row is stored; file names without the ids that writers draw."""
    return F.xxhash64(F.lit(seed), F.regexp_replace("_metadata.file_name", _DRAWN_ID, ""), "_metadata.row_index")


def _tasks(n: int, task_rows: int) -> int:
    return max(1, -(-n // task_rows))


def _orders(sizes: DataFrame, seed: int, tasks: int) -> DataFrame:
    """(bucket, start, places) for (bucket, n): row i of a bucket, in order of keys, goes to start + places[i]."""
    return durable(_starts(sizes).repartition(tasks, "bucket").select("bucket", "start", _inverse(fisher_yates(F.col("n").cast("int"), _draw(seed))).alias("places")))


def _placed(rows: DataFrame, orders: DataFrame, order: list[str], shards: int, carried: list[str]) -> DataFrame:
    """carried, shard and slot of rows (with their bucket), numbered within buckets by order."""
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))
    position = F.col("start") + F.get("places", F.col("i") - 1) - 1
    return numbered.join(orders, "bucket").select(*carried, *_place(position, shards))


def plan_shards(records: DataFrame, shards: int = SHARDS, seed: int = SEED, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, occurrence, shard, slot) for records of the first three columns."""
    counted = durable(records.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")))
    n = counted.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    rows = _each(counted).withColumn("key", _key(seed)).withColumn("bucket", _bucket(F.col("key"), n))
    own = ["doc_id", "size", "text_crc32", "occurrence"]
    orders = _orders(rows.groupBy("bucket").agg(F.count("*").alias("n")), seed, _tasks(n, task_rows))
    return _placed(rows, orders, ["key", *own], shards, own)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, stored: bool = False, task_rows: int = TASK_ROWS) -> None:
    """docs in shards: a folder per shard, the rows of each file in slot order.

    Rows must be told apart alike in both readings: stored says that docs is a plain reading of files; all
    else is written once before.
    """
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("columns shard and slot are those of the plan")
    if not stored:
        copy = shared_path(docs.sparkSession, "records")
        docs.write.parquet(copy)
        docs = docs.sparkSession.read.schema(docs.schema).parquet(copy)
    key = place_key(seed)
    n = docs.count()
    orders = _orders(docs.select(_bucket(key, n).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")), seed, _tasks(n, task_rows))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scattered = docs.select(whole, key.alias("key"), _bucket(key, n).alias("bucket")).repartition(_tasks(n, task_rows), "bucket")
    placed = _placed(scattered, orders, ["key"], shards, ["row.*"])
    written = placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard")
    written.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(path)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the records as their written shards have them."""
    docs, path = documents(spark, sf_dir), shared_path(spark, "shards")
    write_shards(docs, path, stored=True)
    schema = T.StructType([*docs.schema, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    written = spark.read.schema(schema).parquet(path).withColumns(record_columns(F.col("text")))
    return written.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
