"""Parsers by source type. Further types are added with ``register_source``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from feedlens.sources.api import parse_api
from feedlens.sources.catalog import classify_source_type
from feedlens.sources.feeds import parse_feed
from feedlens.sources.landed import LandedPayloads
from feedlens.sources.pages import parse_pages

Parser = Callable[[DataFrame], DataFrame]

_PARSERS: dict[str, Parser] = {"rss": parse_feed, "api": parse_api, "html": parse_pages}


def register_source(kind: str, parser: Parser) -> None:
    """Adds or replaces the parser of a source type."""
    _PARSERS[kind] = parser


def register_connector(spark: SparkSession, connector: type[DataSource]) -> str:
    """Makes a connector of the Python data source API known to the session and returns its format.

    A connector gives payload rows; ``parse_payloads`` then applies the parsers by type.
    """
    spark.dataSource.register(connector)
    return connector.name()


def read_landed(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """Raw articles of a landing folder (see ``landed``), as a table or a stream."""
    reader = (spark.readStream if stream else spark.read).format(register_connector(spark, LandedPayloads))
    return parse_payloads(reader.options(**options).load(path))


def source_types() -> list[str]:
    return sorted(_PARSERS)


def parser_for(kind: str) -> Parser:
    if kind not in _PARSERS:
        raise KeyError(f"no collector found for source type: {kind}")
    return _PARSERS[kind]


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads of any type as raw articles, each through the parser of its type."""
    kind = classify_source_type("source_url", "config_metadata")
    parts = [parser(payloads.where(kind == name)) for name, parser in _PARSERS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def unknown_sources(payloads: DataFrame) -> DataFrame:
    """(source_url, error) of payloads whose type has no parser."""
    kind = classify_source_type("source_url", "config_metadata")
    return payloads.where(~kind.isin(list(_PARSERS))).select(
        "source_url", F.concat(F.lit("no collector found for source type: "), kind).alias("error")
    )
