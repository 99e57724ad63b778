"""Quality, trend and ranking scores as row expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions.text import byte_len, col, is_blank
from feedlens.functions.times import age_hours, is_recent


def points(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def unit(c: Column) -> Column:
    """Clamped into [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def ladder(value: Column, steps: list[tuple[float, float]], default: float = 0.0) -> Column:
    """The points of the first threshold that ``value`` reaches."""
    out = F.when(value >= steps[0][0], F.lit(steps[0][1]))
    for threshold, score in steps[1:]:
        out = out.when(value >= threshold, F.lit(score))
    return out.otherwise(F.lit(default))


def quality_score(
    as_of: datetime | str,
    title: str = "title",
    url: str = "url",
    source: str = "source",
    summary: str = "summary",
    content: str = "content",
    tags: str = "tags",
    published_at: str = "published_at",
) -> Column:
    """Completeness and freshness of an article, 0 to 1."""
    named = (F.col(title) != "") & (F.col(url) != "") & (F.col(source) != "")
    tag_count = F.size(F.col(tags))
    return F.least(
        points(named, 0.3)
        + points(F.col(summary) != "", 0.2)
        + points(byte_len(summary).between(50, 150), 0.1)
        + points(tag_count > 0, 0.1)
        + points(tag_count >= 3, 0.1)
        + points(is_recent(published_at, as_of, 30), 0.1)
        + points(F.col(content) != "", 0.1),
        F.lit(1.0),
    )


def trend_score(
    as_of: datetime | str,
    stars: str = "stars",
    forks: str = "forks",
    updated_at: str = "updated_at",
    description: str = "description",
) -> Column:
    """Popularity and activity of a repository, 0 to 1."""
    return F.least(
        ladder(F.col(stars), [(1000, 0.4), (100, 0.3), (10, 0.2), (1, 0.1)])
        + ladder(F.col(forks), [(100, 0.2), (10, 0.15), (1, 0.1)])
        + points(is_recent(updated_at, as_of, 30), 0.2)
        + points(is_recent(updated_at, as_of, 7), 0.1)
        + points(~is_blank(description), 0.1),
        F.lit(1.0),
    )


def popularity_tier(stars: Column | str = "stars") -> Column:
    c = col(stars)
    return (
        F.when(c >= 10000, "viral")
        .when(c >= 1000, "very_popular")
        .when(c >= 100, "popular")
        .when(c >= 10, "gaining_traction")
        .otherwise("new_or_niche")
    )


def activity_level(as_of: datetime | str, updated_at: Column | str = "updated_at") -> Column:
    return (
        F.when(is_recent(updated_at, as_of, 7), "very_active")
        .when(is_recent(updated_at, as_of, 30), "active")
        .when(is_recent(updated_at, as_of, 90), "moderate")
        .otherwise("inactive")
    )


def is_popular(stars: Column | str = "stars", forks: Column | str = "forks") -> Column:
    return (col(stars) >= 100) | ((col(stars) >= 10) & (col(forks) >= 5))


def is_trending(trend: Column | str = "trend_score") -> Column:
    return col(trend) >= 0.7


# --- ranking scores ---------------------------------------------------------------------


def time_decay(as_of: datetime | str, published_at: Column | str = "published_at") -> Column:
    return F.exp(F.lit(-0.01) * age_hours(published_at, as_of))


def article_trend(
    as_of: datetime | str, quality: Column | str = "quality", published_at: Column | str = "published_at"
) -> Column:
    """Quality plus a bonus that fades over the first day, week and month."""
    hours = age_hours(published_at, as_of)
    fresh = (
        F.when(hours <= 24, F.lit(0.6))
        .when(hours <= 168, F.lit(0.4) * (F.lit(1.0) - (hours - 24) / F.lit(144.0)))
        .when(hours <= 720, F.lit(0.2) * (F.lit(1.0) - (hours - 168) / F.lit(552.0)))
        .otherwise(F.lit(0.0))
    )
    return F.least(col(quality) * F.lit(0.4) + fresh, F.lit(1.0))


def composite_score(
    as_of: datetime | str,
    relevance_weight: float = 0.4,
    time_weight: float = 0.3,
    popularity_weight: float = 0.2,
    trend_weight: float = 0.1,
) -> Column:
    return (
        F.col("relevance") * F.lit(relevance_weight)
        + time_decay(as_of) * F.lit(time_weight)
        + F.col("quality") * F.lit(popularity_weight)
        + article_trend(as_of) * F.lit(trend_weight)
    )


def repo_time_score(as_of: datetime | str, updated_at: Column | str = "updated_at") -> Column:
    out = F.lit(0.2)
    for days, score in [(365, 0.4), (90, 0.6), (30, 0.8), (7, 1.0)]:
        out = F.when(is_recent(updated_at, as_of, days), F.lit(score)).otherwise(out)
    return out


def repo_composite(
    as_of: datetime | str,
    time_weight: float = 0.3,
    popularity_weight: float = 0.3,
    trend_weight: float = 0.2,
) -> Column:
    stars = F.least(F.log10(F.col("stars").cast("double") + 1) / F.lit(5.0), F.lit(1.0))
    return (
        F.col("trend_score") * F.lit(trend_weight)
        + repo_time_score(as_of) * F.lit(time_weight)
        + stars * F.lit(popularity_weight)
    )
