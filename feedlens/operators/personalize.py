"""Reader preferences and the general processing jobs."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.scores import time_decay, trend_score
from feedlens.operators import ordering
from feedlens.operators.lexicon import lexicon_relevance
from feedlens.operators.summarize import fill_summaries, fill_tags


@dataclass(frozen=True)
class Preferences:
    """Preferences of one reader; ``topic_weights`` replace the default boosts."""

    favorite_topics: list[str] = field(default_factory=list)
    preferred_sources: list[str] = field(default_factory=list)
    topic_weights: dict[str, float] = field(default_factory=dict)
    recency: float = 0.0
    languages: list[str] = field(default_factory=list)


def _boost(c: Column, by: Column) -> Column:
    return F.least(c + by, F.lit(1.0))


def personalize_articles(df: DataFrame, prefs: Preferences, as_of: datetime | str) -> DataFrame:
    """Raises the quality of preferred sources and recent articles and the relevance of the
    first favourite topic found in title, summary or tags."""
    quality = F.col("quality")
    if prefs.preferred_sources:
        preferred = F.col("source").isin(prefs.preferred_sources)
        quality = F.when(preferred, _boost(quality, F.lit(0.1))).otherwise(quality)
    if prefs.recency > 0:
        quality = _boost(quality, time_decay(as_of) * F.lit(prefs.recency) * F.lit(0.1))
    relevance = F.col("relevance")
    if prefs.favorite_topics:
        boost = F.when(F.lit(False), F.lit(0.0))
        for topic in prefs.favorite_topics:
            weight = F.lit(float(prefs.topic_weights.get(topic, 0.1)))
            boost = boost.when(_article_has(F.lit(topic.lower())), weight)
        relevance = _boost(relevance, boost.otherwise(F.lit(0.0)))
    return df.withColumns({"quality": quality, "relevance": relevance})


def _article_has(topic: Column) -> Column:
    return (
        F.contains(F.lower("title"), topic)
        | F.contains(F.lower("summary"), topic)
        | F.exists("tags", lambda t: F.contains(F.lower(t), topic))
    )


def personalize_repos(df: DataFrame, prefs: Preferences) -> DataFrame:
    """Raises the trend score for preferred languages and the first favourite topic found."""
    score = F.col("trend_score")
    if prefs.languages:
        liked = F.lower("language").isin([name.lower() for name in prefs.languages])
        score = F.when(liked, _boost(score, F.lit(0.1))).otherwise(score)
    if prefs.favorite_topics:
        boost = F.when(F.lit(False), F.lit(0.0))
        for topic in prefs.favorite_topics:
            custom = prefs.topic_weights.get(topic)
            weight = 0.05 if custom is None else custom * 0.5
            needle = F.lit(topic.lower())
            text = [F.contains(F.lower(c), needle) for c in ("name", "description", "full_name")]
            boost = boost.when(text[0] | text[1] | text[2], F.lit(float(weight)))
        score = _boost(score, boost.otherwise(F.lit(0.0)))
    return df.withColumn("trend_score", score)


def process_articles(
    df: DataFrame,
    as_of: datetime | str,
    query: str = "",
    sort_by: str = "",
    limit: int = 0,
    config: ordering.SortConfig = ordering.ARTICLE_SORT,
    lexicon: dict[str, float] | None = None,
) -> DataFrame:
    """Fills missing summaries and tags, scores relevance for a query, sorts and limits.

    Any non-empty ``sort_by`` means the configured sort; its value is not used.
    """
    out = fill_summaries(df)
    if query:
        out = lexicon_relevance(out, query, lexicon)
    out = fill_tags(out)
    if sort_by:
        out = out.orderBy(*ordering.order_articles_by(config, as_of))
    return out.limit(limit) if limit > 0 else out


def process_repositories(
    df: DataFrame, as_of: datetime | str, sort_by: str = "", sort_order: str = "", limit: int = 0
) -> DataFrame:
    """Rescores the trend; any ``sort_by`` sorts by it, descending only for "desc"."""
    out = df.withColumn("trend_score", trend_score(as_of))
    if sort_by:
        key = ordering.score_key("trend_score")
        out = out.orderBy(key.desc() if sort_order == "desc" else key.asc(), F.col("id"), F.col("ingest_seq"))
    return out.limit(limit) if limit > 0 else out
