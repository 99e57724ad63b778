"""Conforming raw articles into the article and repository entities."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.arrays import pin
from feedlens.functions.identity import article_id, repo_id
from feedlens.functions.scores import quality_score, trend_score
from feedlens.functions.text import (
    byte_len,
    col,
    drop_scripts,
    first_paragraph,
    first_sentences,
    is_blank,
    replace_all,
    shorten,
    text,
    tidy_content,
    tidy_text,
    tidy_title,
    trim_space,
    unescape,
)
from feedlens.functions.times import CONFORM_LAYOUTS, at, parse_timestamp
from feedlens.functions.urls import host, is_parseable, normalize_url


# --- metadata ---------------------------------------------------------------------------


def set_metadata(metadata: Column | str, key: str, value: Column) -> Column:
    """Sets a key, replacing an earlier value."""
    base = F.coalesce(col(metadata), F.create_map().cast("map<string,string>"))
    others = F.map_filter(base, lambda k, _: k != F.lit(key))
    return F.map_concat(others, F.create_map(F.lit(key), value.cast("string")))


def get_metadata(metadata: Column | str, key: str) -> Column:
    return F.try_element_at(col(metadata), F.lit(key))


def overlay(base: Column, winner: Column) -> Column:
    """Both maps in one; on equal keys the second wins."""
    keys = F.map_keys(winner)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(keys, k)), winner)


def _with_text(metadata: Column, key: str, value: Column) -> Column:
    return F.when(value != "", set_metadata(metadata, key, value)).otherwise(metadata)


# --- plain conform ----------------------------------------------------------------------


def to_articles(raw: DataFrame, as_of: datetime | str) -> DataFrame:
    """Renames, moves author and language into the metadata, scores quality."""
    metadata = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    metadata = _with_text(metadata, "author", text("author"))
    metadata = _with_text(metadata, "language", text("language"))
    return raw.select(
        "id", "title", "url", "source", "source_type", "published_at", "summary", "content",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.lit(0.5).alias("relevance"),
        quality_score(as_of).alias("quality"),
        metadata.alias("metadata"),
        "ingest_seq",
    )


def _count_of(key: str) -> Column:
    digits = F.when(get_metadata("metadata", key).rlike(r"^[+-]?[0-9]+$"), get_metadata("metadata", key))
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def to_repositories(raw: DataFrame, as_of: datetime | str, real_updated_at: bool = False) -> DataFrame:
    """Repositories from code-host articles.

    ``updated_at`` is the publication time of the article, which the parser fills with the
    creation time; ``real_updated_at`` takes the metadata's own value where it parses.
    """
    updated = F.col("published_at")
    if real_updated_at:
        updated = F.coalesce(parse_timestamp(get_metadata("metadata", "updated_at"), CONFORM_LAYOUTS), updated)
    repos = raw.select(
        "id",
        F.col("title").alias("name"),
        F.col("title").alias("full_name"),
        F.col("summary").alias("description"),
        "url",
        text("language").alias("language"),
        _count_of("stars").alias("stars"),
        _count_of("forks").alias("forks"),
        updated.alias("updated_at"),
        "metadata",
        "ingest_seq",
    )
    return repos.withColumn("trend_score", trend_score(as_of))


# --- normalisers ------------------------------------------------------------------------


def normalize_source(c: Column | str) -> Column:
    value = col(c)
    named = F.when(value.startswith("http") & is_parseable(value), host(value)).otherwise(value)
    return F.regexp_replace(F.lower(trim_space(named)), r"^www\.", "")


def normalize_source_type(c: Column | str) -> Column:
    value = F.lower(trim_space(c))
    return F.when(value.isin(vocab.SOURCE_TYPES), value).otherwise(F.lit("api"))


def normalize_time(c: Column | str, from_zone: str = "UTC") -> Column:
    """Zone-less UTC of a local time in ``from_zone``."""
    return F.convert_timezone(F.lit(from_zone), F.lit("UTC"), col(c).cast("timestamp_ntz"))


def normalize_tags(c: Column | str) -> Column:
    """Trimmed, folded tags without empty ones, ones over 50 bytes and repeats, in order.

    Entities are decoded once over the joined tags, since Arrow functions cannot run inside
    an array lambda; U+001F cannot occur in a tag.
    """
    joined = tidy_text_keeping_marks(F.array_join(col(c), "\x1f"))
    parts = F.transform(F.split(joined, "\x1f"), lambda t: F.lower(trim_space(t)))
    return F.array_distinct(F.filter(parts, lambda t: (t != "") & (byte_len(t) <= 50)))


def tidy_text_keeping_marks(c: Column) -> Column:
    return tidy_text(c)


def has_tag(tags: Column | str, tag: str) -> Column:
    return F.array_contains(col(tags), tag.strip().lower())


def add_tags(tags: Column | str, new: list[str]) -> Column:
    """Appends trimmed, folded tags that are not there yet."""
    folded = [t.strip().lower() for t in new]
    extra = F.array(*[F.lit(t) for t in folded if t]).cast("array<string>")
    return F.concat(col(tags), F.array_except(extra, col(tags)))


def derive_summary(summary: Column | str, content: Column | str, limit: int = 1000) -> Column:
    """The provided summary if it has 10 to ``limit`` bytes, else the first sentences."""
    given = tidy_content(summary)
    usable = byte_len(given).between(10, limit)
    return F.when(usable, given).otherwise(first_sentences(tidy_content(content), limit))


def require_fields(
    title: str = "title", url: str = "url", source: str = "source", source_type: str = "source_type"
) -> Column:
    """The first missing field as an error text, else NULL."""
    return (
        F.when(is_blank(text(title)), "title is required")
        .when(is_blank(text(url)), "URL is required")
        .when(is_blank(text(source)), "source is required")
        .when(is_blank(text(source_type)), "sourceType is required")
    )


# --- steps per source type --------------------------------------------------------------


def clean_rss_title(c: Column | str) -> Column:
    """Removes feed prefixes, one pattern after the other."""
    out = col(c)
    for pattern in vocab.RSS_TITLE_PREFIXES:
        out = F.regexp_replace(out, "(?d)" + pattern, "")
    return out


def unescape_json_title(c: Column | str) -> Column:
    return replace_all(c, [('\\"', '"'), ("\\\\", "\\")])


def unescape_json_content(c: Column | str) -> Column:
    return replace_all(c, [('\\"', '"'), ("\\\\n", "\n"), ("\\\\t", "\t")])


def drop_page_chrome(c: Column | str) -> Column:
    """Removes navigation, ads, comments, scripts and styles of a scraped page."""
    out = col(c)
    for pattern in vocab.PAGE_CHROME:
        out = F.regexp_replace(out, "(?is)" + pattern, "")
    return out


def page_headline(c: Column | str) -> Column:
    """The part before the earliest site separator, if it has five bytes or more."""
    title = col(c)
    ends = [F.nullif(F.instr(title, sep), F.lit(0)) for sep in vocab.TITLE_SEPARATORS]
    first = F.least(*ends)
    head = trim_space(F.substring(title, F.lit(1), first - 1))
    return F.when(first.isNotNull() & (byte_len(head) >= 5), head).otherwise(title)


def prepare_by_source_type(raw: DataFrame, as_of: datetime | str) -> DataFrame:
    """Title, content, summary, time and metadata as each source type needs them."""
    kind = F.lower("source_type")
    rss, api, page = kind == "rss", kind == "api", kind == "html"
    title, content, summary = F.col("title"), F.col("content"), F.col("summary")
    metadata = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    undated = page & F.col("published_at").isNull()
    return pin(
        raw,
        **{
            "title": F.when(rss, clean_rss_title(title))
            .when(api, unescape_json_title(title))
            .when(page, unescape(F.when(page, page_headline(title))))
            .otherwise(title),
            "content": F.when(api, unescape_json_content(content))
            .when(page, unescape(F.when(page, drop_page_chrome(content))))
            .otherwise(content),
            "summary": F.when(rss & (summary == "") & (content != ""), first_paragraph(content))
            .when(page, unescape(F.when(page, summary)))
            .otherwise(summary),
            "published_at": F.when(undated, at(as_of)).otherwise(F.col("published_at")),
            "metadata": F.when(api, set_metadata(metadata, "api_processed", F.lit("true")))
            .when(undated, set_metadata(metadata, "date_fallback", F.lit("true")))
            .otherwise(metadata),
        },
    )


# --- full conversion --------------------------------------------------------------------


@dataclass(frozen=True)
class ConvertOptions:
    max_summary: int = 1000
    max_title: int = 500
    max_content: int | None = 50000  # None keeps whole texts
    relevance: float = 0.0
    drop_tracking: bool = True


def convert_articles(
    raw: DataFrame, as_of: datetime | str, options: ConvertOptions = ConvertOptions()
) -> DataFrame:
    """Raw articles with every normaliser applied and an ``error`` column (NULL = good).

    A missing publication time becomes ``as_of``. Row count and order key are kept, so good
    and bad rows can be split with ``where``.
    """
    missing = require_fields()
    texts = {c: text(c) for c in ("id", "title", "content", "summary", "author", "url", "source", "source_type", "language")}
    prepared = prepare_by_source_type(pin(raw, **texts, _missing=missing), as_of)
    metadata = F.create_map().cast("map<string,string>")
    metadata = _with_text(metadata, "author", tidy_text("author"))
    metadata = _with_text(metadata, "language", F.lower(trim_space("language")))
    # each text is cleaned once; later rules read the result instead of cleaning again
    staged = pin(
        prepared,
        _title=trim_space(tidy_title("title", options.max_title)),
        _url=trim_space(normalize_url("url", options.drop_tracking)),
        _content=tidy_content("content", options.max_content),
        _given=tidy_content("summary"),
        _tags=normalize_tags("tags"),
        _metadata=overlay(metadata, F.col("metadata")),
    ).select(
        "ingest_seq",
        "_missing",
        "_given",
        F.col("_title").alias("title"),
        F.col("_url").alias("url"),
        normalize_source("source").alias("source"),
        normalize_source_type("source_type").alias("source_type"),
        F.coalesce(F.col("published_at"), at(as_of)).alias("published_at"),
        F.col("_content").alias("content"),
        F.col("_tags").alias("tags"),
        F.col("_metadata").alias("metadata"),
    )
    derived = F.when(byte_len("_given").between(10, options.max_summary), F.col("_given")).otherwise(
        first_sentences("content", options.max_summary)
    )
    staged = pin(staged, _summary=trim_space(derived))
    # a summary over the limit gets a second try at half of it
    summary = F.when(
        byte_len("_summary") > options.max_summary, shorten("_summary", options.max_summary // 2)
    ).otherwise(F.col("_summary"))
    scored = (
        pin(staged, summary=summary)
        .withColumn("id", article_id())
        .withColumn("relevance", F.lit(options.relevance))
        .withColumn("quality", quality_score(as_of))
    )
    error = (
        F.when(F.col("_missing").isNotNull(), F.concat(F.lit("invalid collector article: "), F.col("_missing")))
        .when(
            byte_len("summary") < 10,
            "failed to set summary: summary too short (minimum 10 characters)",
        )
        .when(
            article_error().isNotNull(),
            F.concat(F.lit("converted article failed validation: "), article_error()),
        )
    )
    return scored.select(
        "id", "title", "url", "source", "source_type", "published_at", "summary", "content",
        "tags", "relevance", "quality", "metadata", "ingest_seq", error.alias("error"),
    )


def convert_repositories(df: DataFrame, as_of: datetime | str) -> DataFrame:
    """Repositories from (name, full_name, url, metadata), with an ``error`` column."""
    described = text(get_metadata("metadata", "description"))
    cleaned = tidy_content(described)
    description = F.when(byte_len(cleaned) <= 1000, cleaned).otherwise(_if_fits(tidy_content(shorten(described, 1000)), 1000))
    language = _if_fits(tidy_text(text(get_metadata("metadata", "language"))), 50)

    def count(key: str) -> Column:
        value = get_metadata("metadata", key)
        number = F.when(value.rlike(r"^[+-]?[0-9]+$"), value).try_cast("bigint")
        return F.coalesce(F.when(number >= 0, number), F.lit(0).cast("bigint"))

    updated = parse_timestamp(text(get_metadata("metadata", "updated_at")), CONFORM_LAYOUTS)
    missing = (
        F.when(is_blank(text("name")), "repository name is required")
        .when(is_blank(text("full_name")), "repository fullName is required")
        .when(is_blank(text("url")), "repository URL is required")
    )
    built = df.select(
        missing.alias("_missing"),
        tidy_text(text("name")).alias("name"),
        tidy_text(text("full_name")).alias("full_name"),
        trim_space(normalize_url(text("url"))).alias("url"),
        description.alias("description"),
        language.alias("language"),
        count("stars").alias("stars"),
        count("forks").alias("forks"),
        F.coalesce(updated, at(as_of)).alias("updated_at"),
        "metadata",
        "ingest_seq",
    )
    scored = built.withColumn("id", repo_id()).withColumn("trend_score", trend_score(as_of))
    error = F.coalesce(
        F.col("_missing"),
        F.concat(F.lit("converted repository failed validation: "), repository_error()),
    )
    return scored.select(
        "id", "name", "full_name", "description", "url", "language", "stars", "forks",
        "trend_score", "updated_at", "metadata", "ingest_seq", error.alias("error"),
    )


def _if_fits(c: Column, limit: int) -> Column:
    return F.when(byte_len(c) <= limit, c).otherwise(F.lit(""))


# --- validation -------------------------------------------------------------------------


def article_error() -> Column:
    """The first broken rule of an article, else NULL."""
    return (
        F.when(F.col("id") == "", "ID is required")
        .when(is_blank("title"), "Title is required")
        .when(byte_len("title") > 500, "Title must not exceed 500 characters")
        .when(is_blank("url"), "URL is required")
        .when(is_blank("source"), "Source is required")
        .when(byte_len("source") > 100, "Source must not exceed 100 characters")
        .when(~F.col("source_type").isin(vocab.SOURCE_TYPES), "SourceType must be one of: [rss api html]")
        .when(F.col("published_at").isNull(), "PublishedAt is required")
        .when((F.col("summary") != "") & (byte_len("summary") < 10), "Summary must be at least 10 characters")
        .when(byte_len("summary") > 1000, "Summary must not exceed 1000 characters")
        .when(~F.col("relevance").between(0.0, 1.0), "Relevance must be between 0.0 and 1.0")
        .when(~F.col("quality").between(0.0, 1.0), "Quality must be between 0.0 and 1.0")
    )


def repository_error() -> Column:
    """The first broken rule of a repository, else NULL."""
    return (
        F.when(F.col("id") == "", "ID is required")
        .when(is_blank("name"), "Name is required")
        .when(byte_len("name") > 100, "Name must not exceed 100 characters")
        .when(is_blank("full_name"), "FullName is required")
        .when(byte_len("full_name") > 200, "FullName must not exceed 200 characters")
        .when(is_blank("url"), "URL is required")
        .when(byte_len("description") > 1000, "Description must not exceed 1000 characters")
        .when(byte_len("language") > 50, "Language must not exceed 50 characters")
        .when(F.col("stars") < 0, "Stars cannot be negative")
        .when(F.col("forks") < 0, "Forks cannot be negative")
        .when(~F.col("trend_score").between(0.0, 1.0), "TrendScore must be between 0.0 and 1.0")
        .when(F.col("updated_at").isNull(), "UpdatedAt is required")
    )


def validate_articles(df: DataFrame) -> DataFrame:
    return df.withColumn("error", article_error())


def validate_repositories(df: DataFrame) -> DataFrame:
    return df.withColumn("error", repository_error())


def error_summary(df: DataFrame) -> DataFrame:
    """Rows per error; good rows count under an empty error."""
    return df.groupBy(text("error").alias("error")).agg(F.count(F.lit(1)).alias("rows"))


# --- updates and derived columns --------------------------------------------------------


def update_repo_stats(repos: DataFrame, updates: DataFrame, as_of: datetime | str) -> DataFrame:
    """Applies (full_name, stars, forks, updated_at) updates and rescores the trend.

    An update with a negative number is refused and reported in ``update_error``. Updates
    are expected to hold one row per repository.
    """
    u = updates.select(
        F.col("full_name").alias("_key"),
        F.col("stars").alias("_stars"),
        F.col("forks").alias("_forks"),
        F.col("updated_at").alias("_updated_at"),
    )
    problem = F.when(F.col("_stars") < 0, "stars cannot be negative").when(
        F.col("_forks") < 0, "forks cannot be negative"
    )
    joined = repos.join(u, repos["full_name"] == u["_key"], "left").withColumn("update_error", problem)
    applies = F.col("_key").isNotNull() & F.col("update_error").isNull()
    changed = joined.withColumns(
        {c: F.when(applies, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("stars", "forks", "updated_at")}
    )
    return changed.withColumn(
        "trend_score", F.when(applies, trend_score(as_of)).otherwise(F.col("trend_score"))
    ).drop("_key", "_stars", "_forks", "_updated_at")


def article_measures() -> dict[str, Column]:
    return {
        "title_length": F.char_length("title").cast("long"),
        "summary_length": F.char_length("summary").cast("long"),
    }


def repo_measures() -> dict[str, Column]:
    parts = F.split("full_name", "/")
    return {
        "owner": F.get(parts, F.lit(0)),
        "repo": F.coalesce(F.get(parts, F.lit(1)), F.col("name")),
        "has_language": ~is_blank("language"),
    }
