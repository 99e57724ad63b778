"""Row filters. All are plain predicates, so they reach the scan where the source allows it."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.text import byte_len, contains_any
from feedlens.functions.times import at, moment
from feedlens.operators.conform import get_metadata


@dataclass(frozen=True)
class ArticleFilter:
    """Empty lists and None mean no restriction. Comparisons are case-sensitive."""

    keywords: list[str] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    date_from: datetime | str | None = None
    date_to: datetime | str | None = None
    min_length: int = 0
    max_length: int = 0


def filter_articles(df: DataFrame, rule: ArticleFilter) -> DataFrame:
    """Raw articles that meet every restriction of the rule."""
    keep: list[Column] = []
    if rule.languages:
        keep.append(F.col("language").isin(rule.languages))
    if rule.date_from is not None:
        # an unset time counts as earlier than any bound
        keep.append(F.col("published_at") >= at(rule.date_from))
    if rule.date_to is not None:
        keep.append(F.col("published_at").isNull() | (F.col("published_at") <= at(rule.date_to)))
    if rule.authors:
        keep.append(contains_any("author", rule.authors))
    if rule.tags:
        keep.append(F.exists("tags", lambda t: contains_any(t, rule.tags)))
    if rule.min_length > 0:
        keep.append(byte_len("content") >= rule.min_length)
    if rule.max_length > 0:
        keep.append(byte_len("content") <= rule.max_length)
    if rule.keywords:
        keep.append(contains_any("title", rule.keywords) | contains_any("content", rule.keywords))
    for condition in keep:
        df = df.where(condition)
    return df


@dataclass(frozen=True)
class Period:
    start: datetime
    end: datetime

    @property
    def days(self) -> int:
        return int((self.end - self.start).total_seconds() / 86400)


def resolve_period(as_of: datetime | str, start: str = "", end: str = "") -> Period:
    """The reporting period: by default the seven days up to ``as_of``."""
    last = datetime.strptime(end, "%Y-%m-%d") if end else moment(as_of)
    first = datetime.strptime(start, "%Y-%m-%d") if start else last - timedelta(days=7)
    period = Period(first, last)
    if first > last:
        raise ValueError("start date is after end date")
    if period.days > 30:
        raise ValueError("a period covers at most 30 days")
    return period


def filter_period(df: DataFrame, period: Period, column: str = "published_at") -> DataFrame:
    """Strictly within the period widened by one hour on both sides."""
    return df.where(
        (F.col(column) > at(period.start - timedelta(hours=1)))
        & (F.col(column) < at(period.end + timedelta(hours=1)))
    )


def filter_category_articles(df: DataFrame, category: str, match: str = "equal") -> DataFrame:
    """Articles tagged with the category, or whose headline matches one of its keywords.

    ``match="equal"`` wants title and summary together to equal a keyword;
    ``match="substring"`` looks for the keyword inside them.
    """
    if not category:
        return df
    if match not in ("equal", "substring"):
        raise ValueError(f"unknown match {match!r}")
    keywords = vocab.CATEGORY_KEYWORDS.get(category, [category])
    headline = F.concat_ws(" ", "title", "summary")
    by_text = headline.isin(keywords) if match == "equal" else contains_any(headline, keywords)
    return df.where(F.array_contains("tags", category) | by_text)


def filter_min_quality(df: DataFrame, minimum: float = 0.5) -> DataFrame:
    return df.where(F.col("quality") >= F.lit(minimum))


def is_fork() -> Column:
    return F.coalesce(get_metadata("metadata", "is_fork").isin(vocab.TRUE_WORDS), F.lit(False))


def is_frontend() -> Column:
    text = F.lower(F.concat_ws(" ", "name", "description", "full_name"))
    languages = [name.lower() for name in vocab.FRONTEND_LANGUAGES]
    return F.lower("language").isin(languages) | contains_any(text, vocab.FRONTEND_KEYWORDS)


def filter_repos(
    df: DataFrame,
    min_stars: int = 5,
    include_forks: bool = False,
    frontend_only: bool = False,
    category: str = "",
) -> DataFrame:
    """Cheap predicates first; an unknown category lets everything pass."""
    keep = F.col("stars") >= min_stars
    if not include_forks:
        keep = keep & ~is_fork()
    if frontend_only:
        keep = keep & is_frontend()
    if category in vocab.REPO_CATEGORY_KEYWORDS:
        text = F.lower(F.concat_ws(" ", "name", "description"))
        keep = keep & contains_any(text, vocab.REPO_CATEGORY_KEYWORDS[category])
    return df.where(keep)


def filter_min_score(df: DataFrame, minimum: float, column: str = "relevance") -> DataFrame:
    return df.where(F.col(column) >= F.lit(minimum))
