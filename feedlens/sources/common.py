"""Shared shape of the parsers.

A payload row is (source_url, body, config_tags, config_language, config_metadata,
fetched_at, payload_seq). Items get ``ingest_seq`` from the payload number and their position,
which keeps the order "first payload first, then document order".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.text import text

ITEMS_PER_PAYLOAD = 1_000_000

RAW_COLUMNS = [
    "id", "title", "content", "summary", "author", "url", "published_at", "tags", "source",
    "source_type", "language", "metadata", "ingest_seq", "position",
]


def no_strings() -> Column:
    return F.array().cast("array<string>")


def config_tags() -> Column:
    return F.coalesce(F.col("config_tags"), no_strings())


def config_map() -> Column:
    return F.coalesce(F.col("config_metadata"), F.create_map().cast("map<string,string>"))


def ingest_seq() -> Column:
    return F.col("payload_seq") * F.lit(ITEMS_PER_PAYLOAD) + F.col("position")


def raw_article(items: DataFrame, kind: str, language: Column | None = None, **columns: Column) -> DataFrame:
    """Assembles parsed columns into the raw article shape; absent text becomes empty."""
    out = {
        "id": text(columns["id"]),
        "title": text(columns["title"]),
        "content": text(columns["content"]),
        "summary": text(columns["summary"]),
        "author": text(columns["author"]),
        "url": text(columns["url"]),
        "published_at": columns["published_at"],
        "tags": columns["tags"],
        "source": F.col("source_url"),
        "source_type": F.lit(kind),
        "language": text("config_language") if language is None else text(language),
        "metadata": columns["metadata"],
        "ingest_seq": ingest_seq(),
        "position": F.col("position").cast("long"),
    }
    return items.select(*[c.alias(name) for name, c in out.items()])
