"""Topic search over articles, repositories and discussions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.times import at, moment
from feedlens.functions.topic import (
    article_topic_relevance,
    discussion_topic_relevance,
    repo_topic_relevance,
)
from feedlens.operators import filters, ordering, reports
from feedlens.operators.conversations import with_relevance
from feedlens.plans.result import QueryResult, check_choice, check_range

_RANGE_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def topic_search(
    articles: DataFrame,
    repositories: DataFrame,
    discussions: DataFrame,
    query: str,
    as_of: datetime | str,
    platform: str = "",
    search_type: str = "all",
    time_range: str = "month",
    min_score: float = 0.15,
    max_results: int = 30,
    sort_by: str = "relevance",
    output: str = "json",
    tech_weights: dict[str, float] | None = None,
    enforce_time_range: bool = False,
    turns: DataFrame | None = None,
) -> QueryResult:
    """Scores each entity against the query, filters, ranks and shares out the limit.

    ``platform`` and ``search_type`` gate the entities: repositories come from the code host,
    articles from the article service; discussions take part whenever they are asked for.
    ``time_range`` restricts rows only with ``enforce_time_range``. With ``turns`` (id, turn, role, text)
    the discussions are scored turn by turn and need no ``content``.
    """
    if not query.strip():
        raise ValueError("query is required")
    min_score, max_results = min_score or 0.15, max_results or 30
    sort_by, output = sort_by or "relevance", output or "json"
    time_range, search_type = time_range or "month", search_type or "all"
    check_range("max_results", max_results, 1, 100)
    check_range("min_score", min_score, 0.0, 1.0)
    check_choice("output", output, vocab.REQUEST_FORMATS)
    check_choice("sort_by", sort_by, vocab.TOPIC_SORTS)
    check_choice("time_range", time_range, vocab.TOPIC_RANGES)
    check_choice("search_type", search_type, vocab.SEARCH_TYPES)

    wants_repos = platform in ("", "github") and search_type in ("all", "repositories")
    wants_articles = platform in ("", "dev.to") and search_type in ("all", "articles")
    wants_talks = platform == "" and search_type in ("all", "discussions")
    entities = {
        "articles": (articles, wants_articles, "relevance", article_topic_relevance(query, tech_weights), "published_at"),
        "repositories": (repositories, wants_repos, "trend_score", repo_topic_relevance(query), "updated_at"),
        "discussions": (discussions, wants_talks, "relevance", discussion_topic_relevance(query), "created_at"),
    }
    quota = dict(zip(entities, ordering.proportional_quota(max_results)))
    rows = {}
    for name, (df, wanted, column, score, when) in entities.items():
        if not wanted:
            df = df.where(F.lit(False))
        if enforce_time_range and time_range in _RANGE_DAYS:
            df = df.where(F.col(when) >= at(moment(as_of) - timedelta(days=_RANGE_DAYS[time_range])))
        if name == "discussions" and turns is not None and wanted:
            scored = with_relevance(df, turns, query)
        else:
            scored = df.withColumn(column, score if wanted else F.lit(0.0))
        scored = filters.filter_min_score(scored, min_score, column)
        # a quota of zero keeps nothing, unlike "no limit"
        rows[name] = scored.orderBy(*ordering.order_topic(sort_by, name)).limit(quota[name])
    return QueryResult(
        rows=rows,
        reports={
            "summary": reports.search_summary(rows["articles"], rows["repositories"], rows["discussions"]),
            "keywords": reports.search_keywords(rows["articles"]),
            "platforms": reports.platform_info(rows["articles"], rows["discussions"]),
        },
        settings={
            "query": query,
            "searched_at": moment(as_of),
            "output": output,
            "max_summary": 150,
            "turns": turns,
            "order": {name: ordering.order_topic(sort_by, name) for name in rows},
        },
    )
