"""Rendering of a query result."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.times import moment
from feedlens.operators import ordering
from feedlens.operators.conversations import with_content
from feedlens.plans.result import QueryResult
from feedlens.sinks import items
from feedlens.sinks.documents import render_mixed, renderer_for
from feedlens.sinks.settings import RenderSettings


def render(result: QueryResult, as_of: datetime | str, output: str | None = None) -> DataFrame:
    """One row ``report``: articles, repositories, or both for a topic search."""
    settings = RenderSettings(
        output=output or str(result.settings.get("output", "json")),
        metadata=True,
        max_summary=int(result.settings.get("max_summary", 150)),
    )
    rows = result.rows
    if "articles" in rows and "repositories" in rows:
        return render_mixed(rows["articles"], rows["repositories"], settings, as_of)
    entity = next(iter(rows))
    return renderer_for(settings.output)(rows[entity], entity, settings, as_of)


def _talk_object(settings: RenderSettings) -> Column:
    return F.struct(
        F.col("content"),
        F.date_format("created_at", settings.date_format).alias("createdAt"),
        "id", "platform", "relevance", "replies", "score", "title",
    )


_OBJECTS = {"articles": items.article_object, "repositories": items.repo_object, "discussions": _talk_object}


def _ranked_objects(result: QueryResult, settings: RenderSettings) -> dict[str, Column]:
    """The rows of each entity as one array in the order of the query; the rows are bounded by its limit."""
    out = {}
    for entity, df in result.rows.items():
        if entity == "discussions" and "content" not in df.columns:
            df = with_content(df, result.settings["turns"])
        numbered = ordering.numbered(df, result.settings["order"][entity], "index")
        pairs = F.collect_list(F.struct("index", _OBJECTS[entity](settings).alias("item")))
        pairs = F.array_sort(pairs, lambda x, y: (x["index"] - y["index"]).cast("int"))
        out[entity] = numbered.agg(F.transform(pairs, lambda p: p["item"])).scalar()
    return out


def _rows(report: DataFrame, **names: str) -> Column:
    """A report as an array, largest count first, with the columns under new names."""
    ranked = F.struct((-F.col("count")).alias("o"), F.struct(*[F.col(c).alias(n) for n, c in names.items()]).alias("r"))
    return report.agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda e: e["r"])).scalar()


def _map(report: DataFrame, key: str) -> Column:
    return report.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "count"))))).scalar()


def _value(report: DataFrame, column: str) -> Column:
    return report.select(column).scalar()


def whole_result(result: QueryResult, as_of: datetime | str, indent: bool = True) -> DataFrame:
    """One row ``report``: the entire result as one JSON object, its rows, counts and reports.

    ``indent`` writes it over several lines.
    """
    settings = RenderSettings(metadata=True, max_summary=0)
    chosen, reports = result.settings, result.reports
    stamp = F.lit(moment(as_of).strftime("%Y-%m-%d %H:%M:%S"))
    fields = dict(_ranked_objects(result, settings))
    if "searched_at" in chosen:
        summary = reports["summary"]
        fields |= {
            "query": F.lit(chosen["query"]),
            "searchTime": stamp,
            "totalResults": _value(summary, "total_results"),
            "summary": F.struct(
                _value(summary, "average_score").alias("averageScore"),
                F.struct(*[_value(summary, c).alias(c) for c in ("articles", "discussions", "repositories")]).alias("searchStats"),
                _rows(reports["keywords"], tag="tag", count="count").alias("topicKeywords"),
            ),
            "sources": _rows(reports["platforms"], name="name", type="type", count="count", quality="quality"),
        }
    elif "time_range" in chosen:
        totals, stars = reports["totals"], reports["star_totals"]
        fields |= {
            "filterCount": _value(totals, "filter_count"),
            "language": F.lit(chosen["language"] or None),
            "sources": _rows(reports["hosts"], name="name", count="count", quality="quality"),
            "summary": F.struct(
                _map(reports["activity"], "level").alias("activityLevel"),
                _value(stars, "average_stars").alias("averageStars"),
                _map(reports["stars"], "bucket").alias("starDistribution"),
                _rows(reports["languages"], name="name", count="count", percentage="percentage", totalStars="total_stars").alias(
                    "topLanguages"
                ),
                _value(stars, "total_stars").alias("totalStars"),
                _rows(reports["topics"], topic="topic").alias("trendingTopics"),
            ),
            "timeRange": F.lit(chosen["time_range"]),
            "totalCount": _value(totals, "total_count"),
            "updatedAt": stamp,
        }
    else:
        totals, period = reports["totals"], chosen["period"]
        fields |= {
            "filterCount": _value(totals, "filter_count"),
            "period": F.struct(
                F.lit(period.days).alias("days"),
                F.lit(period.end.strftime("%Y-%m-%d")).alias("end"),
                F.lit(period.start.strftime("%Y-%m-%d")).alias("start"),
            ),
            "sources": _rows(reports["sources"], name="name", count="count", type="type"),
            "summary": _value(reports["summary"], "summary"),
            "totalCount": _value(totals, "total_count"),
        }
    whole = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    spark = next(iter(result.rows.values())).sparkSession
    return spark.range(1).select(F.to_json(whole, {"pretty": str(indent).lower()}).alias("report"))
