"""Weekly digest: collected articles to a ranked list with source and topic counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from feedlens import vocab
from feedlens.operators import filters, ordering, reports
from feedlens.operators.dedup import dedup_articles
from feedlens.operators.lexicon import lexicon_relevance
from feedlens.plans.result import QueryResult, check_choice, check_range


def weekly_news(
    articles: DataFrame,
    as_of: datetime | str,
    start: str = "",
    end: str = "",
    category: str = "",
    min_quality: float = 0.5,
    max_results: int = 50,
    sort_by: str = "relevance",
    output: str = "json",
    lexicon: dict[str, float] | None = None,
    category_match: str = "equal",
) -> QueryResult:
    """De-duplicates, keeps the period, quality and category, scores relevance and ranks.

    Zero and empty settings take the defaults. Source counts and the total cover the
    de-duplicated articles before filtering.
    """
    min_quality = min_quality or 0.5
    max_results = max_results or 50
    sort_by, output = sort_by or "relevance", output or "json"
    check_range("min_quality", min_quality, 0.0, 1.0)
    check_range("max_results", max_results, 1, 200)
    check_choice("output", output, vocab.REQUEST_FORMATS)
    check_choice("sort_by", sort_by, vocab.WEEKLY_SORTS)
    period = filters.resolve_period(as_of, start, end)

    unique = dedup_articles(articles)
    kept = filters.filter_period(unique, period)
    kept = filters.filter_min_quality(kept, min_quality)
    kept = filters.filter_category_articles(kept, category, category_match)
    scored = lexicon_relevance(kept, category, lexicon)
    order = ordering.order_weekly(sort_by)
    ranked = ordering.top(scored, order, max_results)
    return QueryResult(
        rows={"articles": ranked},
        reports={
            "sources": reports.source_counts(unique),
            "topics": reports.topic_counts(ranked),
            "totals": reports.weekly_totals(unique, ranked, period),
            "summary": reports.digest_text(ranked, period),
        },
        settings={"period": period, "output": output, "max_summary": 200, "order": {"articles": order}},
    )
