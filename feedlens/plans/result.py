"""Query results: the ranked rows and the reports derived from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class QueryResult:
    """``rows`` per entity (each bounded by the result limit) and ``reports`` by name.

    Everything is lazy. ``reuse()`` keeps the bounded rows in memory, so that rendering and
    all reports share one run of the query.
    """

    rows: dict[str, DataFrame]
    reports: dict[str, DataFrame] = field(default_factory=dict)
    settings: dict[str, object] = field(default_factory=dict)

    def reuse(self) -> QueryResult:
        for df in self.rows.values():
            df.persist()
        return self

    def release(self) -> None:
        for df in self.rows.values():
            df.unpersist()


def check_choice(name: str, value: str, allowed: list[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}")


def check_range(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
