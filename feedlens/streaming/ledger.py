"""Callbacks of a stream that act once per micro-batch, also when a batch is replayed.

After a failure Spark may run a micro-batch again. The ledger is a folder of Parquet rows, one
folder per batch. A batch first writes its rows there, replacing what an unfinished try left; then the
callback acts on the rows just written; then the batch is noted as done. A batch that is noted
is skipped. A callback that failed half-way runs again on the same rows, so it should act by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

Action = Callable[[DataFrame, int], None]

_DONE = "batch_id long, rows long"


class BatchLedger:
    """What the batches of one stream gave, below ``folder`` (shared by the cluster)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def done(self) -> DataFrame:
        """(batch_id, rows) of the finished batches."""
        self.spark.createDataFrame([], _DONE).write.mode("ignore").parquet(f"{self.folder}/done")
        return self.spark.read.schema(_DONE).parquet(f"{self.folder}/done")

    def is_done(self, batch_id: int) -> bool:
        return self.done().filter(F.col("batch_id") == batch_id).limit(1).count() > 0

    def rows(self, columns: str) -> DataFrame:
        """The rows of all finished batches, with ``batch_id``; ``columns`` is their schema."""
        given = self.spark.read.schema(f"{columns}, batch_id long").option("basePath", f"{self.folder}/rows")
        finished = self.done().select("batch_id").distinct()
        if not finished.limit(1).count():
            return self.spark.createDataFrame([], f"{columns}, batch_id long")
        return given.parquet(f"{self.folder}/rows").join(F.broadcast(finished), "batch_id", "left_semi")

    def apply(self, batch: DataFrame, batch_id: int, action: Action | None = None) -> None:
        """Writes the batch, lets ``action`` act on what was written, and notes the batch."""
        if self.is_done(batch_id):
            return
        place = f"{self.folder}/rows/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(place)
        written = self.spark.read.schema(batch.schema).parquet(place)
        if action is not None:
            action(written, batch_id)
        noted = written.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.count(F.lit(1)).alias("rows"))
        noted.coalesce(1).write.mode("append").parquet(f"{self.folder}/done")


def on_each_batch(stream: DataFrame, ledger: BatchLedger, checkpoint: str, action: Action | None = None, **trigger) -> StreamingQuery:
    """Starts the stream; each micro-batch goes through the ledger, such as an alert sender or a clean-up job."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: ledger.apply(batch, batch_id, action))
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()


def drained(stream: DataFrame, folder: str, action: Action | None = None) -> DataFrame:
    """Runs everything available through a ledger in ``folder`` and returns its rows."""
    ledger = BatchLedger(stream.sparkSession, f"{folder}/ledger")
    on_each_batch(stream, ledger, f"{folder}/state", action, availableNow=True).awaitTermination()
    return ledger.rows(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema))
