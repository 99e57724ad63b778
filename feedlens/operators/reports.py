"""Aggregates reported next to query results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.scores import activity_level
from feedlens.functions.text import byte_len, contains_any, words
from feedlens.functions.times import at
from feedlens.operators.filters import Period


def rows() -> Column:
    return F.count(F.lit(1))


def tag_counts(articles: DataFrame) -> DataFrame:
    return articles.select(F.explode("tags").alias("tag")).groupBy("tag").agg(rows().alias("count"))


def source_counts(articles: DataFrame) -> DataFrame:
    """Articles per source with the type seen last, largest first."""
    return (
        articles.groupBy(F.col("source").alias("name"))
        .agg(rows().alias("count"), F.max_by("source_type", "ingest_seq").alias("type"))
        .orderBy(F.desc("count"), "name")
    )


def topic_counts(articles: DataFrame, minimum: int = 2, n: int = 5) -> DataFrame:
    """The most frequent tags with at least ``minimum`` uses."""
    return tag_counts(articles).where(F.col("count") >= minimum).orderBy(F.desc("count"), "tag").limit(n)


def digest_text(articles: DataFrame, period: Period) -> DataFrame:
    """One row with the summary sentence of a weekly digest."""
    start, end = period.start.strftime("%Y-%m-%d"), period.end.strftime("%Y-%m-%d")
    total = articles.agg(rows().alias("n"))
    ranked = topic_counts(articles).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), F.col("tag")))).alias("t")
    )
    names = F.array_join(F.transform("t", lambda e: e["tag"]), vocab.DIGEST_JOIN)
    found = F.format_string(vocab.DIGEST_FOUND, F.lit(start), F.lit(end), F.col("n"))
    topics = F.when(F.size("t") > 0, F.format_string(vocab.DIGEST_TOPICS, names)).otherwise("")
    empty = F.format_string(vocab.DIGEST_EMPTY, F.lit(start), F.lit(end))
    return total.withColumn("t", ranked.scalar()).select(
        F.when(F.col("n") == 0, empty).otherwise(F.concat(found, topics)).alias("summary")
    )


def weekly_totals(collected: DataFrame, kept: DataFrame, period: Period) -> DataFrame:
    """Counts before and after filtering and the length of the period, as one row."""
    before = collected.agg(rows().alias("total_count"))
    after = kept.agg(rows().alias("filter_count"))
    return before.withColumns({"filter_count": after.scalar(), "days": F.lit(period.days).cast("long")})


def language_stats(repos: DataFrame, n: int = 10) -> DataFrame:
    """Repositories, share of all repositories and stars per language."""
    per_language = repos.groupBy("language").agg(rows().alias("count"), F.sum("stars").alias("total_stars"))
    total = per_language.agg(F.sum("count")).scalar()
    return (
        per_language.where(F.col("language") != "")
        .select(
            F.col("language").alias("name"),
            "count",
            (F.col("count") / total * 100).alias("percentage"),
            "total_stars",
        )
        .orderBy(F.desc("count"), "name")
        .limit(n)
    )


def star_bucket() -> Column:
    c = F.col("stars")
    return F.when(c >= 10000, "10k+").when(c >= 1000, "1k-10k").when(c >= 100, "100-1k").otherwise("<100")


def star_distribution(repos: DataFrame) -> DataFrame:
    return repos.groupBy(star_bucket().alias("bucket")).agg(rows().alias("count"))


def activity_distribution(repos: DataFrame, as_of: datetime | str) -> DataFrame:
    return repos.groupBy(activity_level(as_of).alias("level")).agg(rows().alias("count"))


def star_totals(repos: DataFrame) -> DataFrame:
    return repos.agg(
        F.coalesce(F.sum("stars"), F.lit(0)).cast("long").alias("total_stars"),
        F.coalesce(F.avg("stars"), F.lit(0.0)).alias("average_stars"),
    )


def repo_topics(repos: DataFrame, minimum: int = 2, n: int = 10) -> DataFrame:
    """The most frequent technology words of names and descriptions."""
    word = F.explode(words(F.lower(F.concat_ws(" ", "name", "description")))).alias("topic")
    return (
        repos.select(word)
        .where((byte_len("topic") > 2) & contains_any("topic", vocab.REPO_TOPIC_WORDS))
        .groupBy("topic")
        .agg(rows().alias("count"))
        .where(F.col("count") >= minimum)
        .orderBy(F.desc("count"), "topic")
        .limit(n)
    )


def repo_host() -> Column:
    url = F.col("url")
    return (
        F.when(F.contains(url, F.lit("gitlab")), "GitLab")
        .when(F.contains(url, F.lit("bitbucket")), "Bitbucket")
        .otherwise("GitHub")
    )


def repo_hosts(repos: DataFrame, as_of: datetime | str) -> DataFrame:
    """Repositories and mean trend score per code host."""
    return (
        repos.groupBy(repo_host().alias("name"))
        .agg(rows().alias("count"), F.avg("trend_score").alias("quality"))
        .withColumn("last_sync", at(as_of))
        .orderBy(F.desc("count"), "name")
    )


def search_keywords(articles: DataFrame, n: int = 5) -> DataFrame:
    return tag_counts(articles).orderBy(F.desc("count"), "tag").limit(n)


def search_summary(articles: DataFrame, repositories: DataFrame, discussions: DataFrame) -> DataFrame:
    """Counts per entity and the mean score over all results, as one row."""
    scores = (
        articles.select(F.lit("a").alias("kind"), F.col("relevance").alias("score"))
        .unionByName(repositories.select(F.lit("r").alias("kind"), F.col("trend_score").alias("score")))
        .unionByName(discussions.select(F.lit("d").alias("kind"), F.col("relevance").alias("score")))
    )
    return scores.agg(
        F.count_if(F.col("kind") == "a").alias("articles"),
        F.count_if(F.col("kind") == "r").alias("repositories"),
        F.count_if(F.col("kind") == "d").alias("discussions"),
        rows().alias("total_results"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"),
    )


def platform_info(articles: DataFrame, discussions: DataFrame) -> DataFrame:
    """Results and mean quality per platform; repositories are left out."""
    both = articles.select(F.col("source").alias("name"), "quality").unionByName(
        discussions.select(F.col("platform").alias("name"), F.col("relevance").alias("quality"))
    )
    return (
        both.groupBy("name")
        .agg(F.lit("mixed").alias("type"), rows().alias("count"), F.avg("quality").alias("quality"))
        .orderBy(F.desc("count"), "name")
    )
