"""Shared pieces of the corpus operators: durable cuts, words, seeded uniforms."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\f\r"
#: One run of them, as a regular expression.
GAP = r"[\x20\x09-\x0D]+"


#: A key with more than one in HEAVY of all rows is salted, so there are fewer than HEAVY such keys; with SALTS salts.
HEAVY, SALTS = 1024, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one stands in on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as compressed columns and read again: smaller than a checkpoint where rows are many."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def heavy(counts: DataFrame, on: str) -> DataFrame:
    """The keys of counts (on, n) with more than one in HEAVY of all rows: fewer than HEAVY keys whatever the input."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return counts.where(F.col("n") * HEAVY > total).select(on)


def join_salted(many: DataFrame, few: DataFrame, on: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """many.join(few, on, how) where few has a row per key; the rows of the keys of hot, as heavy() gives them, spread over SALTS tasks.

    A row's salt is a hash of its content, so that a task run again after a loss deals its rows alike in whatever order they come;
    rows of many that are equal in all columns stay together.
    """
    marked = F.broadcast(hot.select(on, F.lit(True).alias("_hot")))  # fewer than HEAVY rows
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*many.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    left = many.join(marked, on, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = few.join(marked, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [on, "_salt"], how).drop("_salt")


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it: one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_names(df: DataFrame, *kept: str) -> DataFrame:
    """df with columns named by their place but for those of kept, as functions over Arrow batches need it: Spark cannot resolve names with dots there."""
    return df.toDF(*[c if c in kept else f"_{i}" for i, c in enumerate(df.columns)])


def hashable(df: DataFrame) -> list[Column]:
    """The columns of df in a form that can be hashed and compared: those that hold maps as JSON."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Text without outer white space; null is empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words(text: Column) -> Column:
    """The maximal runs of characters outside SPACES; none for null or blank text."""
    inner = trimmed(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def word_count(text: Column) -> Column:
    """size(words(text)) as a long without building the words: each word and the gap after it becomes one letter."""
    return F.length(F.regexp_replace(trimmed(text), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")).cast("long")


def uniform(*keys: Column) -> Column:
    """A double in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0**-53)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of batches in small batches, so that a worker holds few texts twice; freed memory goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()
