"""Request check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.operators import requests
from feedlens.workload import bindings as b
from feedlens.workload.registry import query


def _in(column: str, allowed: list[str]) -> str:
    return f"{column} <> '' AND lower(trim({column})) NOT IN ({', '.join(repr(a) for a in allowed)})"


_FUTURE = "TIMESTAMP '2024-02-01 00:00:00'"
_DATES = {
    "startDate:INVALID_DATE_FORMAT": "NOT regexp_matches(start_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')",
    "dateRange:INVALID_DATE_ORDER": "s > e",
    "dateRange:DATE_RANGE_TOO_LONG": "date_diff('day', s, e) > 90",
    "startDate:FUTURE_DATE_NOT_ALLOWED": f"s > {_FUTURE}",
    "endDate:FUTURE_DATE_NOT_ALLOWED": f"e > {_FUTURE}",
}
_WEEKLY = {
    **_DATES,
    "category:INVALID_CATEGORY": _in("category", vocab.REQUEST_CATEGORIES),
    "minQuality:INVALID_QUALITY_SCORE": "min_quality NOT BETWEEN 0 AND 1",
    "maxResults:INVALID_RESULT_COUNT": "max_results NOT BETWEEN 1 AND 200",
    "format:INVALID_FORMAT": _in("format", vocab.REQUEST_FORMATS),
    "sortBy:INVALID_SORT_BY": _in("sort_by", vocab.WEEKLY_SORTS),
    "sources:INVALID_SOURCES": "contains(sources, 'myblog')",
}
_TOPIC = {
    "query:REQUIRED_FIELD_MISSING": "trim(query) = ''",
    "query:QUERY_TOO_SHORT": "strlen(trim(query)) = 1",
    "query:QUERY_TOO_LONG": "strlen(query) > 200",
    "language:INVALID_LANGUAGE": _in("language", vocab.REQUEST_LANGUAGES),
    "platform:INVALID_PLATFORM": _in("platform", vocab.REQUEST_PLATFORMS),
    "sortBy:INVALID_SORT_BY": _in("sort_by", vocab.TOPIC_SORTS),
    "timeRange:INVALID_TIME_RANGE": _in("time_range", vocab.TOPIC_RANGES),
    "maxResults:INVALID_RESULT_COUNT": "max_results NOT BETWEEN 1 AND 100",
    "format:INVALID_FORMAT": _in("format", vocab.REQUEST_FORMATS),
    "minScore:INVALID_SCORE": "min_quality NOT BETWEEN 0 AND 1",
    "searchType:INVALID_SEARCH_TYPE": _in("search_type", vocab.SEARCH_TYPES),
}
_TRENDING = {
    "language:INVALID_LANGUAGE": _in("language", vocab.REQUEST_LANGUAGES),
    "timeRange:INVALID_TIME_RANGE": _in("time_range", vocab.TRENDING_RANGES),
    "minStars:INVALID_MIN_STARS": "min_stars < 0",
    "minStars:MIN_STARS_TOO_HIGH": "min_stars > 100000",
    "maxResults:INVALID_RESULT_COUNT": "max_results NOT BETWEEN 1 AND 100",
    "category:INVALID_CATEGORY": _in("category", vocab.REPO_CATEGORIES),
    "sortBy:INVALID_SORT_BY": _in("sort_by", vocab.TRENDING_SORTS),
    "format:INVALID_FORMAT": _in("format", vocab.REQUEST_FORMATS),
}
_DATED = "dated AS (SELECT *, try_cast(start_date AS TIMESTAMP) AS s0, try_cast(end_date AS TIMESTAMP) AS e, CASE WHEN contains(start_date, '/') THEN NULL ELSE try_cast(start_date AS TIMESTAMP) END AS s FROM requests)"


def _sql(rules: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in rules.items())
    return (
        b.views("requests", more=_DATED)
        + f"SELECT request_id, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS errors FROM dated"
    )


def _shown(checked):
    marks = F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["code"]))
    return checked.select("request_id", F.array_join(marks, ",").alias("errors"))


@query("validate_weekly_requests", _sql(_WEEKLY))
def _weekly(spark, sf_dir):
    return _shown(requests.validate_weekly_requests(b.requests(spark, sf_dir), b.AS_OF))


@query("validate_topic_requests", _sql(_TOPIC))
def _topic(spark, sf_dir):
    return _shown(requests.validate_topic_requests(b.requests(spark, sf_dir)))


@query("validate_trending_requests", _sql(_TRENDING))
def _trending(spark, sf_dir):
    return _shown(requests.validate_trending_requests(b.requests(spark, sf_dir)))


@query(
    "validation_messages",
    b.views("requests")
    + """SELECT request_id, unnest(list_filter([
           CASE WHEN category <> '' AND lower(trim(category)) = 'cooking' THEN 'category|cooking|分类必须是以下之一: [react vue angular nodejs typescript javascript css testing webpack framework library tool example]' END,
           CASE WHEN max_results NOT BETWEEN 1 AND 200 THEN 'maxResults|' || max_results || '|maxResults 必须在1-200之间' END,
           CASE WHEN contains(sources, 'myblog') THEN 'sources|github,myblog|数据源 ''myblog'' 无效，有效的数据源: [dev.to hackernews reddit medium github]' END], lambda x: x IS NOT NULL)) AS said FROM requests""",
)
def _messages(spark, sf_dir):
    checked = requests.validate_weekly_requests(b.requests(spark, sf_dir), b.AS_OF)
    rows = checked.select("request_id", F.explode("errors").alias("e"))
    return rows.where(F.col("e.field").isin("category", "maxResults", "sources")).select(
        "request_id", F.concat_ws("|", "e.field", "e.value", "e.message").alias("said")
    )


@query(
    "sanitize_queries",
    b.views("requests")
    + """SELECT request_id, CASE WHEN query = '' OR query = 'x' OR contains(query, '<') OR strlen(trim(query)) > 200 THEN '' ELSE trim(query) END AS clean,
         CASE WHEN query IN ('', 'x') THEN '查询关键词至少需要2个字符' WHEN strlen(trim(query)) > 200 THEN '查询关键词不能超过200个字符'
              WHEN contains(query, '<') THEN '查询关键词包含无效字符' ELSE '' END AS problem FROM requests""",
)
def _sanitize(spark, sf_dir):
    rows = requests.sanitize_queries(b.requests(spark, sf_dir))
    return rows.select("request_id", F.col("clean_query").alias("clean"), F.coalesce("query_problem", F.lit("")).alias("problem"))


@query(
    "validation_report",
    f"WITH c AS ({_sql(_WEEKLY)}) SELECT request_id, errors = '' AS success, CASE WHEN errors = '' THEN '' ELSE '参数验证失败' END AS error, "
    "CASE WHEN errors = '' THEN 0 ELSE len(string_split(errors, ',')) END AS details FROM c",
)
def _report(spark, sf_dir):
    checked = requests.validate_weekly_requests(b.requests(spark, sf_dir), b.AS_OF)
    return requests.validation_report(checked).select(
        "request_id", "success", F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce(F.size("details"), F.lit(0)).cast("long").alias("details"),
    )


@query(
    "validation_error_codes",
    f"WITH c AS ({_sql(_TOPIC)}) SELECT split_part(x, ':', 2) AS code, count(*) AS rows FROM (SELECT unnest(string_split(errors, ',')) AS x FROM c WHERE errors <> '') GROUP BY 1",
)
def _codes(spark, sf_dir):
    return requests.error_codes(requests.validate_topic_requests(b.requests(spark, sf_dir)))
