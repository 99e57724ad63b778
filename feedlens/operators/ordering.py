"""Sort orders, limits and pages. Every order is total: ties end at the id and the arrival, ascending."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.functions.scores import article_trend, composite_score, repo_composite
from feedlens.operators.sequence import with_position


def score_key(c: Column | str) -> Column:
    """Scores that differ by less than a billionth count as equal."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def _directed(key: Column, ascending: bool) -> Column:
    return key.asc() if ascending else key.desc()


def _last() -> list[Column]:
    """The ids of repositories repeat, so the arrival decides last."""
    return [F.col("id").asc(), F.col("ingest_seq").asc()]


# --- collected articles -----------------------------------------------------------------


def order_articles(by: str, ascending: bool = True) -> list[Column]:
    """Date, title or author, stable in arrival order; another name keeps that order."""
    keys = {"date": "published_at", "title": "title", "author": "author"}
    arrival = F.col("ingest_seq").asc()
    return [_directed(F.col(keys[by]), ascending), arrival] if by in keys else [arrival]


# --- the three queries ------------------------------------------------------------------


def order_weekly(by: str = "relevance") -> list[Column]:
    keys = {
        "quality": score_key("quality").desc(),
        "date": F.col("published_at").desc(),
        "title": F.col("title").asc(),
    }
    return [keys.get(by, score_key("relevance").desc()), *_last()]


def order_repos(by: str = "trending") -> list[Column]:
    keys = {
        "stars": F.col("stars").desc(),
        "forks": F.col("forks").desc(),
        "updated": F.col("updated_at").desc(),
    }
    return [keys.get(by, score_key("trend_score").desc()), *_last()]


def order_topic(by: str, entity: str) -> list[Column]:
    """Per entity order of a topic search. Articles have no popularity and keep arrival order."""
    score = "trend_score" if entity == "repositories" else "relevance"
    when = {"articles": "published_at", "repositories": "updated_at", "discussions": "created_at"}[entity]
    count = {"repositories": "stars", "discussions": "score"}.get(entity)
    if by == "relevance":
        key = score_key(score).desc()
    elif by == "date":
        key = F.col(when).desc()
    elif count:
        key = F.col(count).desc()
    else:
        return [F.col("ingest_seq").asc()]
    return [key, *_last()]


# --- configurable sorter ----------------------------------------------------------------

SORT_METRICS = ("relevance", "time", "popularity", "trend", "composite")


@dataclass(frozen=True)
class SortConfig:
    primary: str = "composite"
    secondary: str = "time"
    order: str = "desc"
    relevance_weight: float = 0.4
    time_weight: float = 0.3
    popularity_weight: float = 0.2
    trend_weight: float = 0.1


ARTICLE_SORT = SortConfig()
REPO_SORT = SortConfig("trend", "popularity", "desc", 0.2, 0.3, 0.3, 0.2)


def validate_sort_config(config: SortConfig) -> None:
    if config.primary not in SORT_METRICS:
        raise ValueError(f"invalid primary sort criterion: {config.primary}")
    if config.secondary not in SORT_METRICS:
        raise ValueError(f"invalid secondary sort criterion: {config.secondary}")
    if config.order not in ("asc", "desc"):
        raise ValueError(f"invalid sort order: {config.order}")
    total = config.relevance_weight + config.time_weight + config.popularity_weight + config.trend_weight
    if total <= 0:
        raise ValueError("total weight must be greater than 0")


def order_articles_by(config: SortConfig, as_of: datetime | str) -> list[Column]:
    """Primary and secondary metric in one direction; an unknown metric ties all rows."""
    metrics = {
        "relevance": lambda: score_key("relevance"),
        "time": lambda: F.col("published_at"),
        "popularity": lambda: score_key("quality"),
        "trend": lambda: score_key(article_trend(as_of)),
        "composite": lambda: score_key(
            composite_score(
                as_of,
                config.relevance_weight,
                config.time_weight,
                config.popularity_weight,
                config.trend_weight,
            )
        ),
    }
    return _two_keys(metrics, config, None)


def order_repos_by(config: SortConfig, as_of: datetime | str) -> list[Column]:
    """As for articles; an unknown metric means trend."""
    metrics = {
        "trend": lambda: score_key("trend_score"),
        "time": lambda: F.col("updated_at"),
        "popularity": lambda: F.col("stars"),
        "composite": lambda: score_key(
            repo_composite(as_of, config.time_weight, config.popularity_weight, config.trend_weight)
        ),
    }
    return _two_keys(metrics, config, "trend")


def _two_keys(metrics: dict, config: SortConfig, fallback: str | None) -> list[Column]:
    keys = []
    for name in (config.primary, config.secondary):
        metric = metrics.get(name) or metrics.get(fallback)
        if metric is not None:
            keys.append(_directed(metric(), config.order == "asc"))
    return [*keys, *_last()]


# --- rendering --------------------------------------------------------------------------


def order_for_render(entity: str, by: str = "relevance", direction: str = "desc") -> list[Column]:
    if entity == "articles":
        keys = {
            "quality": lambda: score_key("quality"),
            "date": lambda: F.col("published_at"),
            "title": lambda: F.lower("title"),
        }
        default = "relevance"
    else:
        keys = {
            "stars": lambda: F.col("stars"),
            "forks": lambda: F.col("forks"),
            "date": lambda: F.col("updated_at"),
            "title": lambda: F.lower("name"),
        }
        default = "trend_score"
    key = keys[by]() if by in keys else score_key(default)
    return [_directed(key, direction == "asc"), *_last()]


# --- limits and pages -------------------------------------------------------------------


def top(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """Sorted rows, the first ``n`` of them. Spark keeps only ``n`` rows per task."""
    ordered = df.orderBy(*order)
    return ordered if n is None or n <= 0 else ordered.limit(n)


def numbered(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """1-based positions for rows already bounded by a limit.

    The window has one partition; for a whole table use ``sequence.with_position``.
    """
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def proportional_quota(n: int) -> tuple[int, int, int]:
    """Shares of articles, repositories and discussions; the remainder goes to the last."""
    third = n // 3
    return third, third, n - 2 * third


#: Rows that one task may gather to cut a page.
NEAR = 10_000


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    info: DataFrame


def validate_page(page: int, size: int) -> None:
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= size <= 100:
        raise ValueError("page size must be between 1 and 100")


def _totals(total: Column, page: int, size: int) -> list[Column]:
    pages = F.ceil(total / F.lit(size)).cast("long")
    return [
        F.lit(page).cast("long").alias("current_page"),
        F.lit(size).cast("long").alias("page_size"),
        total.alias("total_items"),
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    ]


def paginate(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> Page:
    """One page of the sorted rows and its totals; numbers below one take the defaults.

    A page among the first ``NEAR`` rows is a limit, which one task gathers; a later one is cut
    out by position, so no task holds the rows before it.
    """
    size = size if size > 0 else 20
    page = page if page > 0 else 1
    first = (page - 1) * size
    if first + size <= NEAR:
        rows = df.orderBy(*order).offset(first).limit(size)
    else:
        placed = with_position(df, order, "_position")
        rows = placed.where(F.col("_position").between(first + 1, first + size)).orderBy("_position").drop("_position")
    total = F.count(F.lit(1))
    info = df.agg(*_totals(total, page, size))
    return Page(rows, info)


class PageIndex:
    """A sorted copy of a table, written once, from which any page is read without sorting again.

    The rows lie in folders of ``block_rows`` positions, so a page opens one folder or two, whatever the size
    of the table. The totals are kept beside them.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, df: DataFrame, order: list[Column], folder: str, block_rows: int = 10_000) -> PageIndex:
        """Sorts the rows by ``order``, which must be total, and writes them below ``folder``."""
        index = cls(df.sparkSession, folder)
        placed = with_position(df, order, "_position").withColumn("_block", F.floor((F.col("_position") - 1) / block_rows))
        placed.write.partitionBy("_block").parquet(f"{index.folder}/rows")
        index.spark.createDataFrame([], placed.schema).drop("_block").write.mode("append").parquet(f"{index.folder}/rows/_block=-1")
        totals = df.agg(F.count(F.lit(1)).alias("total_items"), F.lit(block_rows).cast("long").alias("block_rows"))
        totals.write.parquet(f"{index.folder}/totals")
        return index

    def page(self, page: int = 1, size: int = 20) -> Page:
        """The rows of a page with ``_position``, and its totals; numbers below one take the defaults."""
        size = size if size > 0 else 20
        page = page if page > 0 else 1
        first, last = (page - 1) * size + 1, page * size
        totals = self.spark.read.parquet(f"{self.folder}/totals")
        block_rows = totals.first().block_rows
        rows = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows")
        rows = rows.where(F.col("_block").between((first - 1) // block_rows, (last - 1) // block_rows))
        rows = rows.where(F.col("_position").between(first, last)).drop("_block")
        return Page(rows, totals.select(*_totals(F.col("total_items"), page, size)))
