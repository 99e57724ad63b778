"""Running a stream over what has landed so far."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from feedlens.session import ensure_checkpoint_dir


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Processes everything available and returns the written rows.

    State and output live in a new folder below the shared checkpoint folder.
    """
    spark = stream.sparkSession
    base = f"{folder or ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/state")
        .option("path", f"{base}/rows")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
