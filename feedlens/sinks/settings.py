"""Rendering settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RenderSettings:
    """``date_format`` is a Spark datetime pattern; ``max_summary`` in bytes, 0 for no limit."""

    output: str = "json"
    indent: bool = True
    date_format: str = "yyyy-MM-dd HH:mm:ss"
    metadata: bool = False
    content: bool = False
    max_summary: int = 150
    sort_by: str = "relevance"
    sort_order: str = "desc"
    links: bool = True
    compact: bool = False

    @property
    def batch_size(self) -> int:
        return 500 if self.compact else 100
