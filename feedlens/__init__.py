"""feedlens: content-feed analytics expressed as Spark DataFrame operators."""

from feedlens.session import build_session

__all__ = ["build_session"]
