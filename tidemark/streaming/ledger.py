"""A sink with a ledger of batches: resumable work whose rows are there once, whatever was killed in between.

A batch is written whole to a folder of its own, and entered in the ledger afterwards. A batch whose entry is there is
skipped when it comes again, one without an entry is written over. Readers see the batches of the ledger alone,
so that the rows of a write cut short are never seen. The ledger belongs to one checkpoint: a stream that starts anew
without its checkpoint counts its batches from 0 again and needs a new root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRY = "batch_id long, rows long"


class Ledger:
    """The table of a sink at root, in a store that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._rows, self._entries = spark, f"{root}/rows", f"{root}/ledger"
        spark.createDataFrame([], _ENTRY).write.mode("ignore").parquet(self._entries)

    def entries(self) -> DataFrame:
        """(batch_id, rows) of all finished batches."""
        return self._spark.read.schema(_ENTRY).parquet(self._entries)

    def has(self, batch_id: int) -> bool:
        return not self.entries().where(F.col("batch_id") == batch_id).isEmpty()

    def stage(self, batch: DataFrame, batch_id: int) -> None:
        """The rows of a batch in place of what an earlier attempt left, not yet to be seen."""
        batch.write.mode("overwrite").parquet(f"{self._rows}/batch_id={batch_id}")

    def enter(self, batch: DataFrame, batch_id: int) -> None:
        """The staged batch finished: its rows are counted from what was written."""
        n = self._spark.read.schema(batch.schema).parquet(f"{self._rows}/batch_id={batch_id}").count()
        self._spark.createDataFrame([(batch_id, n)], _ENTRY).coalesce(1).write.mode("append").parquet(self._entries)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """What foreachBatch calls."""
        if not self.has(batch_id):
            self.stage(batch, batch_id)
            self.enter(batch, batch_id)

    def read(self, schema: T.StructType) -> DataFrame:
        """The rows of all finished batches; schema is that of the stream. Nothing finished: no rows."""
        done = self.entries().select("batch_id").distinct()
        if done.isEmpty():
            return self._spark.createDataFrame([], schema)
        # folders of unfinished batches are pruned by the join's keys before they are read
        found = self._spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(self._rows)
        return found.join(done, "batch_id", "left_semi").drop("batch_id")


def run_resumable(stream: DataFrame, root: str, checkpoint: str) -> DataFrame:
    """Everything that is there now through the stream into the ledger's table, which is returned; may be called again after any failure."""
    ledger = Ledger(stream.sparkSession, root)
    query = stream.writeStream.foreachBatch(ledger.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return ledger.read(stream.schema)
