"""The registered queries of the operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ["queries_text", "queries_tables", "queries_search"]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries by name in the order of the operators, and their SQL where SQL can express them."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for module in MODULES:
        part = import_module(f"feedlens.llm.{module}")
        queries |= part.QUERIES
        oracles |= part.ORACLES
    number = lambda name: int(name[2:].split("_")[0])
    return {name: queries[name] for name in sorted(queries, key=number)}, oracles
