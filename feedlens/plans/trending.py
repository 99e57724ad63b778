"""Trending repositories: collected repositories to a ranked list with distributions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.scores import trend_score
from feedlens.operators import filters, ordering, reports
from feedlens.operators.dedup import dedup_repos
from feedlens.plans.result import QueryResult, check_choice, check_range


def trending_repos(
    repos: DataFrame,
    as_of: datetime | str,
    language: str = "",
    time_range: str = "weekly",
    min_stars: int = 5,
    max_results: int = 30,
    category: str = "",
    include_forks: bool = False,
    frontend_only: bool = False,
    sort_by: str = "trending",
    output: str = "json",
) -> QueryResult:
    """De-duplicates, filters, rescores and ranks repositories.

    ``language`` and ``time_range`` choose what is read (see ``sources.catalog``) and do not
    filter rows here. All reports describe the ranked rows.
    """
    time_range, min_stars, max_results = time_range or "weekly", min_stars or 5, max_results or 30
    sort_by, output = sort_by or "trending", output or "json"
    if min_stars < 0:
        raise ValueError("min_stars must not be negative")
    check_range("max_results", max_results, 1, 100)
    check_choice("time_range", time_range, vocab.TRENDING_RANGES)
    check_choice("sort_by", sort_by, vocab.TRENDING_SORTS)
    check_choice("output", output, vocab.REQUEST_FORMATS)

    # stars and flags belong to the copy that wins, so the filter follows the de-duplication
    unique = dedup_repos(repos)
    kept = filters.filter_repos(unique, min_stars, include_forks, frontend_only, category)
    scored = kept.withColumn("trend_score", trend_score(as_of))
    order = ordering.order_repos(sort_by)
    ranked = ordering.top(scored, order, max_results)
    count = ranked.agg(F.count(F.lit(1)).alias("total_count")).withColumn("filter_count", F.col("total_count"))
    return QueryResult(
        rows={"repositories": ranked},
        reports={
            "languages": reports.language_stats(ranked),
            "stars": reports.star_distribution(ranked),
            "activity": reports.activity_distribution(ranked, as_of),
            "star_totals": reports.star_totals(ranked),
            "topics": reports.repo_topics(ranked),
            "hosts": reports.repo_hosts(ranked, as_of),
            "totals": count,
        },
        settings={
            "language": language,
            "time_range": time_range,
            "output": output,
            "max_summary": 150,
            "order": {"repositories": order},
        },
    )
