"""Source catalogue: which sources a request reads, their checks and their errors."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.text import col, contains_any, trim_space
from feedlens.functions.times import at, since_date
from feedlens.functions.urls import is_http, is_parseable
from feedlens.operators.conform import get_metadata


def classify_source_type(url: Column | str, metadata: Column | str | None = None) -> Column:
    """The configured type, else feed, API or page by the look of the URL."""
    u = col(url)
    guess = (
        F.when(contains_any(u, [".xml", "/rss", "/feed", "/atom"]), "rss")
        .when(contains_any(u, ["api.github.com", "dev.to/api", "/api/"]), "api")
        .otherwise("html")
    )
    return guess if metadata is None else F.coalesce(get_metadata(metadata, "source_type"), guess)


def source_url_error(url: Column | str) -> Column:
    """Why a source URL cannot be read, else NULL."""
    u = col(url)
    return (
        F.when(u.isNull() | (u == ""), "URL is required")
        .when(~is_parseable(u), "invalid URL")
        .when(~is_http(u), "URL must use http or https scheme")
    )


def cap_per_source(df: DataFrame, cap: Column | int, source: str = "source_url", position: str = "position") -> DataFrame:
    """The first ``cap`` items of each payload; zero means no cap.

    ``position`` is the 0-based place within its payload that every parser provides, so the
    cap is a filter and needs no window.
    """
    limit = F.lit(cap) if isinstance(cap, int) else cap
    return df.where((limit <= 0) | (F.col(position) < limit))


def is_retryable(error: Column | str) -> Column:
    """Whether a failed fetch is worth another try; unknown errors are."""
    text = col(error)
    return text.isNotNull() & ~contains_any(text, vocab.FATAL_FETCH_ERRORS)


def classify_fetch_errors(log: DataFrame, source: str = "source", error: str = "error") -> DataFrame:
    """Failures per source, split into retryable and final ones."""
    failed = log.where(F.col(error).isNotNull())
    return failed.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("failures"),
        F.count_if(is_retryable(error)).alias("retryable"),
        F.count_if(~is_retryable(error)).alias("final"),
    )


# --- catalogues of the three queries ----------------------------------------------------


def digest_catalog(spark: SparkSession) -> DataFrame:
    """The four built-in sources of the weekly digest."""
    rows = [
        (name, url, cap, tags, {"source_type": "api", "platform": "dev.to"})
        for name, url, cap, tags in vocab.DIGEST_SOURCES
    ]
    return spark.createDataFrame(
        rows, "name string, url string, max_articles int, tags array<string>, metadata map<string,string>"
    )


def resolve_sources(requests: DataFrame, catalog: DataFrame, names: str = "sources") -> DataFrame:
    """Requested sources of each request in request order, unknown ones dropped.

    ``requests`` holds comma-separated names; a request without any gets the whole catalogue
    in catalogue order. Repeated names stay repeated. The catalogue is configuration and goes to
    every task; by a shuffle, the requests of a name would meet in one task.
    """
    known = catalog.select(F.col("name"), F.monotonically_increasing_id().alias("_order"))
    everything = known.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_order", "name"))), lambda e: e["name"])
    ).scalar()
    listed = F.filter(F.transform(F.split(names, ","), lambda s: trim_space(s)), lambda s: s != "")
    wanted = F.when(F.coalesce(F.col(names), F.lit("")) == "", everything).otherwise(listed)
    exploded = requests.select("*", F.posexplode(wanted).alias("position", "name"))
    return exploded.join(F.broadcast(catalog), "name")


@dataclass(frozen=True)
class SourceQuery:
    """One search: a predicate on landed repository rows and how many of the best to take."""

    name: str
    condition: Column
    rows: int


def trending_sources(
    as_of: datetime | str, language: str = "", time_range: str = "weekly", category: str = ""
) -> list[SourceQuery]:
    """Language search plus topic searches, four at most, for repositories created lately.

    The predicates are plain comparisons on ``created_at``, ``language`` and ``topics``, so
    they are pushed into the scan.
    """
    recent = F.col("created_at") > at(datetime.combine(since_date(as_of, time_range), datetime.min.time()))
    wanted = (language or "javascript").lower()
    out = [SourceQuery("github_trending", recent & (F.lower("language") == wanted), vocab.TRENDING_LANGUAGE_ROWS)]
    for topic in vocab.TRENDING_TOPICS:
        if len(out) >= vocab.TRENDING_MAX_SOURCES:
            break
        if not category or topic == category:
            condition = recent & F.array_contains("topics", topic)
            out.append(SourceQuery(f"github_topic_{topic}", condition, vocab.TRENDING_TOPIC_ROWS))
    return out


def search_sources(query: str, language: str = "", platform: str = "", search_type: str = "all") -> dict[str, Column]:
    """The sources of a topic search with the predicate each one stands for."""
    out: dict[str, Column] = {}
    if platform in ("", "github") and search_type in ("all", "repositories"):
        out["github_repos"] = F.lower("language") == (language or "javascript").lower()
    if platform in ("", "dev.to") and search_type in ("all", "articles"):
        tag = query if query in ("react", "vue", "angular") else "javascript"
        out["devto"] = F.array_contains("tags", tag)
    return out


def read_trending(repos: DataFrame, sources: list[SourceQuery]) -> DataFrame:
    """The best rows by stars of each source, with ``source_name``; a row may come twice."""
    out: DataFrame | None = None
    for source in sources:
        best = (
            repos.where(source.condition)
            .orderBy(F.desc("stars"), "ingest_seq")
            .limit(source.rows)
            .withColumn("source_name", F.lit(source.name))
        )
        out = best if out is None else out.unionByName(best)
    if out is None:
        raise ValueError("no source to read")
    return out
