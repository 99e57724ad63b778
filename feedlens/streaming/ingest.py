"""Landed payloads as a stream, and de-duplication across micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions.identity import article_hash
from feedlens.schemas import PAYLOAD


def payload_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Payload files of a folder, at most ``max_files`` per micro-batch."""
    return spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", max_files).parquet(path)


def parse_stream(payloads: DataFrame, parser: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A payload stream through a batch parser; the parsers are plain projections."""
    return parser(payloads)


def dedup_stream(
    articles: DataFrame, key: Column | None = None, time: str = "published_at", delay: str = "7 days"
) -> DataFrame:
    """The first article seen of each key, remembered for ``delay`` of event time."""
    keyed = articles.withColumns(
        {"_key": article_hash() if key is None else key, "_time": F.col(time).cast("timestamp")}
    )
    return keyed.withWatermark("_time", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_time", "_key")


def dedup_repo_stream(repos: DataFrame, time: str = "updated_at", delay: str = "7 days") -> DataFrame:
    return dedup_stream(repos, F.lower("full_name"), time, delay)
