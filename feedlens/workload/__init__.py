"""Queries over the given tables, each paired with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

from feedlens.workload.registry import ORACLES, QUERIES, Query

MODULES = ["repos", "articles", "topics", "corpus", "payloads", "web", "operations", "checks", "rendering", "streams"]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All registered queries and their reference SQL."""
    for module in MODULES:
        import_module(f"feedlens.workload.{module}")
    return dict(QUERIES), dict(ORACLES)
