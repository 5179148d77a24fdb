"""An entity's rows meet in one call of the fold, however its input is partitioned."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import sequential


@pytest.fixture
def merged_partitions(spark):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_sides_of_unlike_size(spark, merged_partitions):
    """Wide slides and narrow keys, both numbered by windows: Spark merges few small partitions of keys and none of slides."""
    slides = spark.range(400).select((F.col("id") % 10).alias("video_id"), "id", F.array(*[F.rand(i) for i in range(64)]).alias("v"))
    keys = Window.partitionBy("video_id").orderBy("n")
    pressed = spark.range(30).select((F.col("id") % 10).alias("video_id"), F.col("id").alias("n"), F.lit("n").alias("key")).withColumn("id", F.row_number().over(keys))
    found = sequential.key_session(slides, pressed, "id", "v", "key")
    assert {tuple(r) for r in found.groupBy("video_id").agg(F.count("*"), F.count_if(~F.col("keep"))).collect()} == {(i, 40, 3) for i in range(10)}
