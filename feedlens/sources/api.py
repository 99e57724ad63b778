"""JSON API payloads: code repositories, issues, articles and anything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.arrays import pin
from feedlens.functions.identity import short_id
from feedlens.functions.text import byte_len, shorten, text
from feedlens.functions.times import parse_timestamp
from feedlens.operators.conform import overlay
from feedlens.sources.common import config_map, config_tags, no_strings, raw_article

REPO = """struct<id: bigint, name: string, full_name: string, description: string, html_url: string,
  language: string, created_at: string, updated_at: string, pushed_at: string, stargazers_count: bigint,
  forks_count: bigint, watchers_count: bigint, open_issues_count: bigint, fork: boolean,
  owner: struct<login: string>, topics: array<string>>"""

ISSUE = """struct<id: bigint, number: bigint, title: string, body: string, state: string, html_url: string,
  created_at: string, updated_at: string, user: struct<login: string>, labels: array<struct<name: string>>>"""

POST = """struct<id: bigint, title: string, description: string, body_markdown: string, url: string,
  published_at: string, created_at: string, tag_list: array<string>,
  user: struct<username: string, name: string>, organization: struct<name: string, username: string>,
  reading_time_minutes: bigint>"""

RFC3339 = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"]


def _number(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("string")


def _metadata(**values: Column) -> Column:
    pairs = [part for key, value in values.items() for part in (F.lit(key), value)]
    return overlay(F.create_map(*pairs), config_map())


def parse_github_repos(payloads: DataFrame) -> DataFrame:
    """One raw article per repository, from a search result or a bare list."""
    found = F.from_json("body", f"struct<items: array<{REPO}>>")["items"]
    listed = F.from_json("body", f"array<{REPO}>")
    is_search = F.contains("source_url", F.lit("/search/repositories"))
    items = pin(payloads, _repos=F.when(is_search, found).otherwise(listed)).drop("body")
    items = items.select("*", F.posexplode("_repos").alias("position", "item")).drop("_repos")
    return raw_article(
        items,
        "api",
        language=F.col("item.language"),
        id=_number("item.id"),
        title=F.col("item.full_name"),
        content=F.col("item.description"),
        summary=F.col("item.description"),
        author=F.col("item.owner.login"),
        url=F.col("item.html_url"),
        published_at=parse_timestamp("item.created_at", RFC3339),
        tags=F.concat(F.coalesce("item.topics", no_strings()), config_tags()),
        metadata=_metadata(
            github_repo=F.lit("true"),
            repo_language=text("item.language"),
            created_at=text("item.created_at"),
            updated_at=text("item.updated_at"),
            stars=_number("item.stargazers_count"),
            forks=_number("item.forks_count"),
            watchers=_number("item.watchers_count"),
            open_issues=_number("item.open_issues_count"),
            is_fork=F.coalesce(F.col("item.fork"), F.lit(False)).cast("string"),
        ),
    )


def parse_github_issues(payloads: DataFrame) -> DataFrame:
    """One raw article per issue."""
    items = pin(payloads, _issues=F.from_json("body", f"array<{ISSUE}>")).drop("body")
    items = items.select("*", F.posexplode("_issues").alias("position", "item")).drop("_issues")
    labels = F.coalesce(F.transform("item.labels", lambda label: text(label["name"])), no_strings())
    return raw_article(
        items,
        "api",
        id=_number("item.id"),
        title=F.concat(F.lit("#"), _number("item.number"), F.lit(": "), text("item.title")),
        content=F.col("item.body"),
        summary=shorten(text("item.body"), 200),
        author=F.col("item.user.login"),
        url=F.col("item.html_url"),
        published_at=parse_timestamp("item.created_at", RFC3339),
        tags=F.concat(F.array(F.lit("github-issue"), text("item.state")), labels, config_tags()),
        metadata=_metadata(
            github_issue=F.lit("true"),
            issue_number=_number("item.number"),
            issue_state=text("item.state"),
            created_at=text("item.created_at"),
            updated_at=text("item.updated_at"),
        ),
    )


def parse_devto_articles(payloads: DataFrame) -> DataFrame:
    """One raw article per post; an organisation's name replaces the author's."""
    items = pin(payloads, _posts=F.from_json("body", f"array<{POST}>")).drop("body")
    items = items.select("*", F.posexplode("_posts").alias("position", "item")).drop("_posts")
    person = F.when(text("item.user.name") != "", F.col("item.user.name")).otherwise(F.col("item.user.username"))
    return raw_article(
        items,
        "api",
        id=_number("item.id"),
        title=F.col("item.title"),
        content=F.col("item.body_markdown"),
        summary=F.col("item.description"),
        author=F.when(F.col("item.organization").isNotNull(), F.col("item.organization.name")).otherwise(person),
        url=F.col("item.url"),
        published_at=parse_timestamp("item.published_at", RFC3339),
        tags=F.concat(F.coalesce("item.tag_list", no_strings()), config_tags()),
        metadata=_metadata(
            dev_to_article=F.lit("true"),
            reading_time_minutes=_number("item.reading_time_minutes"),
            published_at=text("item.published_at"),
            created_at=text("item.created_at"),
        ),
    )


def parse_generic_api(payloads: DataFrame) -> DataFrame:
    """The whole payload as one raw article, published when it was fetched."""
    items = payloads.withColumn("position", F.lit(0))
    size = byte_len("body").cast("string")
    return raw_article(
        items,
        "api",
        id=short_id("source_url"),
        title=F.concat(F.lit("API Response from "), F.col("source_url")),
        content=F.col("body"),
        summary=F.concat(F.lit("API response containing "), size, F.lit(" bytes of data")),
        author=F.lit("API"),
        url=F.col("source_url"),
        published_at=F.col("fetched_at"),
        tags=F.concat(F.array(F.lit("api")), config_tags()),
        metadata=config_map(),
    )


def api_kind() -> Column:
    """Which parser a payload URL belongs to; an unknown code-host URL has none."""
    url = F.col("source_url")

    def has(part: str) -> Column:
        return F.contains(url, F.lit(part))

    host = has("api.github.com")
    return (
        F.when(host & has("/repos") & has("/issues"), "issues")
        .when(host & (has("/search/repositories") | (has("/users/") & has("/repos"))), "repos")
        .when(host, "none")
        .when(has("dev.to/api"), "posts")
        .otherwise("generic")
    )


def parse_api(payloads: DataFrame) -> DataFrame:
    """Every payload through the parser of its URL."""
    kind = api_kind()
    return (
        parse_github_repos(payloads.where(kind == "repos"))
        .unionByName(parse_github_issues(payloads.where(kind == "issues")))
        .unionByName(parse_devto_articles(payloads.where(kind == "posts")))
        .unionByName(parse_generic_api(payloads.where(kind == "generic")))
    )
