"""Checks of query requests as a batch job. Every broken rule of a row is reported.

Each check adds ``errors``, an array of (field, value, message, code).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.arrays import pin
from feedlens.functions.text import byte_len, col, replace_all, text, trim_space
from feedlens.functions.times import DAY_US, age_us

_DAY = "yyyy-MM-dd"


def _error(condition: Column, field: str, value: Column, message: Column | str, code: str) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.when(
        condition,
        F.struct(F.lit(field).alias("field"), value.alias("value"), said.alias("message"), F.lit(code).alias("code")),
    )


def _collect(df: DataFrame, checks: list[Column]) -> DataFrame:
    # pinned, as a filter on the errors would otherwise run every check again
    return pin(df, errors=F.array_compact(F.array(*checks)))


def in_list(c: Column | str, allowed: list[str]) -> Column:
    """Membership regardless of case and outer space."""
    return F.lower(trim_space(col(c))).isin(allowed)


def _choice(column: str, field: str, allowed: list[str], code: str, message: str = vocab.MSG_ENUM) -> Column:
    value = text(column)
    listed = " ".join(allowed)
    said = message % (field, listed) if message is vocab.MSG_ENUM else message % listed
    return _error((value != "") & ~in_list(value, allowed), field, value, said, code)


def _score(column: str, field: str, code: str) -> Column:
    value = F.col(column)
    return _error(~value.between(0.0, 1.0), field, F.format_string("%.2f", value), vocab.MSG_SCORE % field, code)


def _count(column: str, field: str, low: int, high: int) -> Column:
    value = F.col(column)
    said = vocab.MSG_COUNT % (field, low, high)
    return _error(~value.between(low, high), field, value.cast("string"), said, "INVALID_RESULT_COUNT")


def date_errors(as_of: datetime | str, start: str = "start_date", end: str = "end_date") -> list[Column]:
    """Format, existence, order, span of at most 90 days, and no date beyond tomorrow."""
    values = {"startDate": text(start), "endDate": text(end)}
    shaped = {f: v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") for f, v in values.items()}
    days = {f: F.when(shaped[f], F.try_to_timestamp(v, F.lit(_DAY))) for f, v in values.items()}
    out = []
    for field, value in values.items():
        given = value != ""
        out.append(_error(given & ~shaped[field], field, value, vocab.MSG_DATE_FORMAT, "INVALID_DATE_FORMAT"))
        unread = given & shaped[field] & days[field].isNull()
        out.append(_error(unread, field, value, vocab.MSG_DATE_PARSE, "DATE_PARSE_ERROR"))
    first, last = days["startDate"], days["endDate"]
    both = F.concat(values["startDate"], F.lit(" to "), values["endDate"])
    out.append(_error(first > last, "dateRange", both, vocab.MSG_DATE_ORDER, "INVALID_DATE_ORDER"))
    span = F.unix_micros(last) - F.unix_micros(first)
    out.append(_error(span > 90 * DAY_US, "dateRange", both, vocab.MSG_DATE_SPAN, "DATE_RANGE_TOO_LONG"))
    for field, said in (("startDate", vocab.MSG_START_FUTURE), ("endDate", vocab.MSG_END_FUTURE)):
        late = age_us(days[field], as_of) < -DAY_US
        out.append(_error(late, field, values[field], said, "FUTURE_DATE_NOT_ALLOWED"))
    return out


def unknown_source(c: Column | str) -> Column:
    """The first listed source that is not known, else NULL."""
    names = F.transform(F.split(text(c), ","), lambda s: F.lower(trim_space(s)))
    return F.get(F.filter(names, lambda s: (s != "") & ~s.isin(vocab.REQUEST_SOURCES)), F.lit(0))


def validate_weekly_requests(df: DataFrame, as_of: datetime | str) -> DataFrame:
    bad_source = unknown_source("sources")
    listed = " ".join(vocab.REQUEST_SOURCES)
    said = F.format_string(vocab.MSG_SOURCE, bad_source, F.lit(listed))
    return _collect(
        df,
        date_errors(as_of)
        + [
            _choice("category", "category", vocab.REQUEST_CATEGORIES, "INVALID_CATEGORY", vocab.MSG_CATEGORY),
            _score("min_quality", "minQuality", "INVALID_QUALITY_SCORE"),
            _count("max_results", "maxResults", 1, 200),
            _choice("format", "format", vocab.REQUEST_FORMATS, "INVALID_FORMAT"),
            _choice("sort_by", "sortBy", vocab.WEEKLY_SORTS, "INVALID_SORT_BY"),
            _error(bad_source.isNotNull(), "sources", text("sources"), said, "INVALID_SOURCES"),
        ],
    )


def query_error(column: str = "query") -> Column:
    """Missing, too short once trimmed, or too long as given."""
    value = text(column)
    size = byte_len(trim_space(value))
    return F.coalesce(
        _error(size == 0, "query", value, vocab.MSG_QUERY_EMPTY, "REQUIRED_FIELD_MISSING"),
        _error(size < 2, "query", value, vocab.MSG_QUERY_SHORT, "QUERY_TOO_SHORT"),
        _error(byte_len(value) > 200, "query", value, vocab.MSG_QUERY_LONG, "QUERY_TOO_LONG"),
    )


def validate_topic_requests(df: DataFrame) -> DataFrame:
    return _collect(
        df,
        [
            query_error(),
            _choice("language", "language", vocab.REQUEST_LANGUAGES, "INVALID_LANGUAGE", vocab.MSG_LANGUAGE),
            _choice("platform", "platform", vocab.REQUEST_PLATFORMS, "INVALID_PLATFORM"),
            _choice("sort_by", "sortBy", vocab.TOPIC_SORTS, "INVALID_SORT_BY"),
            _choice("time_range", "timeRange", vocab.TOPIC_RANGES, "INVALID_TIME_RANGE"),
            _count("max_results", "maxResults", 1, 100),
            _choice("format", "format", vocab.REQUEST_FORMATS, "INVALID_FORMAT"),
            _score("min_quality", "minScore", "INVALID_SCORE"),
            _choice("search_type", "searchType", vocab.SEARCH_TYPES, "INVALID_SEARCH_TYPE"),
        ],
    )


def validate_trending_requests(df: DataFrame) -> DataFrame:
    stars = F.col("min_stars")
    shown = stars.cast("string")
    return _collect(
        df,
        [
            _choice("language", "language", vocab.REQUEST_LANGUAGES, "INVALID_LANGUAGE", vocab.MSG_LANGUAGE),
            _choice("time_range", "timeRange", vocab.TRENDING_RANGES, "INVALID_TIME_RANGE"),
            _error(stars < 0, "minStars", shown, vocab.MSG_STARS_NEGATIVE, "INVALID_MIN_STARS"),
            _error(stars > 100000, "minStars", shown, vocab.MSG_STARS_HIGH, "MIN_STARS_TOO_HIGH"),
            _count("max_results", "maxResults", 1, 100),
            _choice("category", "category", vocab.REPO_CATEGORIES, "INVALID_CATEGORY"),
            _choice("sort_by", "sortBy", vocab.TRENDING_SORTS, "INVALID_SORT_BY"),
            _choice("format", "format", vocab.REQUEST_FORMATS, "INVALID_FORMAT"),
        ],
    )


def sanitize(c: Column | str) -> Column:
    """Markup characters escaped (the ampersand last, so escapes are escaped again), control
    characters dropped, ends trimmed."""
    escaped = replace_all(c, vocab.QUERY_ESCAPES)
    return trim_space(F.regexp_replace(escaped, r"[\x00-\x1f\x7f]", ""))


def sanitize_queries(df: DataFrame, column: str = "query") -> DataFrame:
    """Adds ``clean_query``, empty where ``query_problem`` names a broken rule."""
    clean = sanitize(text(column))
    problem = (
        F.when(byte_len(clean) < 2, vocab.MSG_QUERY_SHORT)
        .when(byte_len(clean) > 200, vocab.MSG_QUERY_LONG)
        .when(~clean.rlike(vocab.QUERY_CHARSET), vocab.MSG_QUERY_CHARS)
    )
    return df.withColumns({"clean_query": F.when(problem.isNull(), clean).otherwise(""), "query_problem": problem})


def validation_report(checked: DataFrame) -> DataFrame:
    """Adds ``success`` and, for failures, the answer text and its details."""
    failed = F.size("errors") > 0
    return checked.withColumns(
        {"success": ~failed, "error": F.when(failed, vocab.MSG_INVALID), "details": F.when(failed, F.col("errors"))}
    )


def error_codes(checked: DataFrame) -> DataFrame:
    """Rows per error code."""
    return checked.select(F.explode("errors.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("rows"))
