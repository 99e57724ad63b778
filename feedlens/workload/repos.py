"""Repository queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import scores
from feedlens.functions.identity import repo_hash, repo_id
from feedlens.operators import conform, filters, ordering, personalize, readers, reports
from feedlens.operators.dedup import dedup_repos
from feedlens.operators.sequence import with_position
from feedlens.plans.trending import trending_repos
from feedlens.session import ensure_checkpoint_dir
from feedlens.workload import bindings as b
from feedlens.workload.registry import query

_SCORED = f"""
unique_repos AS (
  SELECT * FROM repositories QUALIFY row_number() OVER (PARTITION BY lower(full_name) ORDER BY ingest_seq) = 1
),
scored AS (SELECT *, {b.TREND_SQL} AS trend_score FROM unique_repos),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY round(trend_score, 9) DESC, id) AS rank FROM scored
  WHERE stars >= 5 AND NOT is_fork
  QUALIFY row_number() OVER (ORDER BY round(trend_score, 9) DESC, id) <= 30
)
"""
TOP30 = b.views("repositories", more=_SCORED)


def _ranked(spark: SparkSession, sf_dir: str):
    return trending_repos(b.repositories(spark, sf_dir), b.REPO_AS_OF)


def _report(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _ranked(spark, sf_dir).reports[name]


@query(
    "trending_repos",
    TOP30
    + """SELECT id, name, full_name, url, language, stars, forks, round(trend_score, 6) AS trend_score,
         strftime(updated_at, '%Y-%m-%d') AS updated_on FROM ranked""",
)
def _trending(spark, sf_dir):
    return _ranked(spark, sf_dir).rows["repositories"].select(
        "id", "name", "full_name", "url", "language", "stars", "forks",
        F.round("trend_score", 6).alias("trend_score"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"),
    )


@query(
    "trending_repos_frontend_tools",
    b.views("repositories", more=f"""
unique_repos AS (
  SELECT * FROM repositories QUALIFY row_number() OVER (PARTITION BY lower(full_name) ORDER BY ingest_seq) = 1
),
scored AS (SELECT *, {b.TREND_SQL} AS trend_score FROM unique_repos)""")
    + """SELECT id, full_name, stars, round(trend_score, 6) AS trend_score FROM scored
         WHERE stars >= 100
           AND (lower(language) IN ('javascript','typescript','css','html','vue','sass','less')
                OR regexp_matches(lower(name || ' ' || description || ' ' || full_name),
                   'javascript|typescript|react|vue|angular|frontend|css|html|sass|scss|webpack|vite|next\\.js|nuxt|ui|component|framework|library|web|browser'))
           AND regexp_matches(lower(name || ' ' || description), 'tool|cli|build|webpack|vite|rollup|babel')
         ORDER BY stars DESC, id LIMIT 100""",
)
def _trending_tools(spark, sf_dir):
    result = trending_repos(
        b.repositories(spark, sf_dir), b.REPO_AS_OF, min_stars=100, max_results=100, category="tool",
        include_forks=True, frontend_only=True, sort_by="stars",
    )
    return result.rows["repositories"].select(
        "id", "full_name", "stars", F.round("trend_score", 6).alias("trend_score")
    )


@query(
    "repo_trend_score",
    b.views("repositories")
    + f"SELECT ingest_seq, round({b.TREND_SQL}, 6) AS trend_score FROM repositories",
)
def _trend(spark, sf_dir):
    return b.repositories(spark, sf_dir).select(
        "ingest_seq", F.round(scores.trend_score(b.REPO_AS_OF), 6).alias("trend_score")
    )


@query(
    "repo_labels",
    b.views("repositories", more=f"s AS (SELECT *, {b.TREND_SQL} AS trend_score FROM repositories)")
    + """SELECT ingest_seq,
           CASE WHEN stars >= 10000 THEN 'viral' WHEN stars >= 1000 THEN 'very_popular' WHEN stars >= 100 THEN 'popular'
                WHEN stars >= 10 THEN 'gaining_traction' ELSE 'new_or_niche' END AS tier,
           CASE WHEN age_us <= 604800000000 THEN 'very_active' WHEN age_us <= 2592000000000 THEN 'active'
                WHEN age_us <= 7776000000000 THEN 'moderate' ELSE 'inactive' END AS activity,
           stars >= 100 OR (stars >= 10 AND forks >= 5) AS popular, trend_score >= 0.7e0 AS trending,
           split_part(full_name, '/', 1) AS owner, split_part(full_name, '/', 2) AS repo,
           trim(language) <> '' AS has_language
         FROM s""",
)
def _labels(spark, sf_dir):
    repos = b.repositories(spark, sf_dir).withColumn("trend_score", scores.trend_score(b.REPO_AS_OF))
    derived = conform.repo_measures()
    return repos.select(
        "ingest_seq",
        scores.popularity_tier().alias("tier"),
        scores.activity_level(b.REPO_AS_OF).alias("activity"),
        scores.is_popular().alias("popular"),
        scores.is_trending().alias("trending"),
        *[c.alias(name) for name, c in derived.items()],
    )


@query(
    "repo_ids",
    b.views("repositories")
    + """SELECT ingest_seq, 'repo_' || left(md5(lower(trim(full_name))), 11) AS id,
         md5(lower(full_name) || '|' || url) AS hash FROM repositories""",
)
def _ids(spark, sf_dir):
    return b.repositories(spark, sf_dir).select("ingest_seq", repo_id().alias("id"), repo_hash().alias("hash"))


@query(
    "dedup_repos",
    b.views("repositories")
    + "SELECT lower(full_name) AS full_name, min(ingest_seq) AS ingest_seq FROM repositories GROUP BY 1",
)
def _dedup(spark, sf_dir):
    return dedup_repos(b.repositories(spark, sf_dir)).select(F.lower("full_name").alias("full_name"), "ingest_seq")


for _category, _pattern in {
    "framework": "framework|react|vue|angular|next\\.js|nuxt|svelte",
    "library": "library|util|helper|component|ui",
    "example": "example|demo|sample|template|boilerplate",
    "unlisted": "",
}.items():

    @query(
        f"filter_repos_{_category}",
        b.views("repositories")
        + f"""SELECT ingest_seq, stars FROM repositories WHERE stars >= 700 AND NOT is_fork
              AND regexp_matches(lower(name || ' ' || description), '{_pattern}')""",
    )
    def _filter(spark, sf_dir, category=_category):
        rows = filters.filter_repos(b.repositories(spark, sf_dir), 700, category=category)
        return rows.select("ingest_seq", "stars")


@query(
    "validate_repositories",
    b.views("repositories")
    + """SELECT CASE WHEN octet_length(encode(name)) > 100 THEN 'Name must not exceed 100 characters'
                     WHEN trim(url) = '' THEN 'URL is required' ELSE '' END AS error, count(*) AS rows
         FROM repositories GROUP BY 1""",
)
def _validate(spark, sf_dir):
    return conform.error_summary(conform.validate_repositories(b.repositories(spark, sf_dir)))


@query(
    "update_repo_stats",
    b.views("repositories", more=f"""
unique_repos AS (
  SELECT * FROM repositories QUALIFY row_number() OVER (PARTITION BY lower(full_name) ORDER BY ingest_seq) = 1
),
updates AS (
  SELECT full_name, forks * 10 - 100 AS new_stars, stars AS new_forks, age_us - 864000000000 AS new_age
  FROM unique_repos WHERE ingest_seq % 2 = 0
),
merged AS (
  SELECT r.ingest_seq, r.description, u.full_name IS NOT NULL AND u.new_stars >= 0 AS applies,
         coalesce(u.new_stars < 0, false) AS refused, r.stars AS s, r.forks AS f, r.age_us AS a, u.*
  FROM unique_repos r LEFT JOIN updates u ON r.full_name = u.full_name
),
final AS (
  SELECT ingest_seq, description, applies, refused, CASE WHEN applies THEN new_stars ELSE s END AS stars,
         CASE WHEN applies THEN new_forks ELSE f END AS forks, CASE WHEN applies THEN new_age ELSE a END AS age_us
  FROM merged
)""")
    + f"""SELECT ingest_seq, stars, forks, CASE WHEN refused THEN 'stars cannot be negative' ELSE '' END AS problem,
          CASE WHEN applies THEN round({b.TREND_SQL}, 6) ELSE 0.5e0 END AS trend_score FROM final""",
)
def _update(spark, sf_dir):
    repos = dedup_repos(b.repositories(spark, sf_dir))
    updates = repos.where(F.col("ingest_seq") % 2 == 0).select(
        "full_name",
        (F.col("forks") * 10 - 100).alias("stars"),
        F.col("stars").alias("forks"),
        (F.col("updated_at") + F.make_interval(days=F.lit(10))).alias("updated_at"),
    )
    return conform.update_repo_stats(repos, updates, b.REPO_AS_OF).select(
        "ingest_seq", "stars", "forks",
        F.coalesce("update_error", F.lit("")).alias("problem"),
        F.round("trend_score", 6).alias("trend_score"),
    )


# --- reports over the ranked rows -------------------------------------------------------


@query(
    "repo_language_stats",
    TOP30
    + """SELECT language AS name, count(*) AS count, round(count(*) * 100e0 / (SELECT count(*) FROM ranked), 6) AS percentage,
         CAST(sum(stars) AS BIGINT) AS total_stars FROM ranked WHERE language <> '' GROUP BY 1
         ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _languages(spark, sf_dir):
    return _report(spark, sf_dir, "languages").withColumn("percentage", F.round("percentage", 6))


@query(
    "repo_language_stats_all",
    b.views("repositories")
    + """SELECT language AS name, count(*) AS count, round(count(*) * 100e0 / (SELECT count(*) FROM repositories), 6) AS percentage,
         CAST(sum(stars) AS BIGINT) AS total_stars FROM repositories WHERE language <> '' GROUP BY 1
         ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _languages_all(spark, sf_dir):
    return reports.language_stats(b.repositories(spark, sf_dir)).withColumn("percentage", F.round("percentage", 6))


@query(
    "repo_star_distribution",
    b.views("repositories")
    + """SELECT CASE WHEN stars >= 10000 THEN '10k+' WHEN stars >= 1000 THEN '1k-10k' WHEN stars >= 100 THEN '100-1k'
         ELSE '<100' END AS bucket, count(*) AS count FROM repositories GROUP BY 1""",
)
def _stars(spark, sf_dir):
    return reports.star_distribution(b.repositories(spark, sf_dir))


@query(
    "repo_activity_distribution",
    b.views("repositories")
    + """SELECT CASE WHEN age_us <= 604800000000 THEN 'very_active' WHEN age_us <= 2592000000000 THEN 'active'
         WHEN age_us <= 7776000000000 THEN 'moderate' ELSE 'inactive' END AS level, count(*) AS count
         FROM repositories GROUP BY 1""",
)
def _activity(spark, sf_dir):
    return reports.activity_distribution(b.repositories(spark, sf_dir), b.REPO_AS_OF)


@query(
    "repo_star_totals",
    b.views("repositories")
    + """SELECT CAST(sum(stars) AS BIGINT) AS total_stars, round(avg(stars), 6) AS average_stars FROM repositories""",
)
def _star_totals(spark, sf_dir):
    return reports.star_totals(b.repositories(spark, sf_dir)).withColumn("average_stars", F.round("average_stars", 6))


@query(
    "repo_topics",
    b.views("repositories")
    + """SELECT topic, count(*) AS count FROM (
           SELECT unnest(string_split_regex(lower(name || ' ' || description), '\\s+')) AS topic FROM repositories)
         WHERE strlen(topic) > 2 AND regexp_matches(topic,
           'react|vue|angular|javascript|typescript|css|html|node|express|webpack|vite|babel|eslint|prettier|tailwind|bootstrap|sass|less|redux|mobx|graphql|rest|api|ui|component|library|framework|tool')
         GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _topics(spark, sf_dir):
    return reports.repo_topics(b.repositories(spark, sf_dir))


@query(
    "repo_hosts",
    b.views("repositories", more=f"s AS (SELECT *, {b.TREND_SQL} AS trend_score FROM repositories)")
    + """SELECT CASE WHEN contains(url, 'gitlab') THEN 'GitLab' WHEN contains(url, 'bitbucket') THEN 'Bitbucket'
         ELSE 'GitHub' END AS name, count(*) AS count, round(avg(trend_score), 6) AS quality,
         '2001-11-05' AS last_sync FROM s GROUP BY 1""",
)
def _hosts(spark, sf_dir):
    repos = b.repositories(spark, sf_dir).withColumn("trend_score", scores.trend_score(b.REPO_AS_OF))
    return reports.repo_hosts(repos, b.REPO_AS_OF).select(
        "name", "count", F.round("quality", 6).alias("quality"),
        F.date_format("last_sync", "yyyy-MM-dd").alias("last_sync"),
    )


# --- sorter -----------------------------------------------------------------------------

_COMPOSITE_SQL = """(trend_score * 0.2e0
  + CASE WHEN age_us <= 604800000000 THEN 1e0 WHEN age_us <= 2592000000000 THEN 0.8e0
         WHEN age_us <= 7776000000000 THEN 0.6e0 WHEN age_us <= 31536000000000 THEN 0.4e0 ELSE 0.2e0 END * 0.3e0
  + least(1e0, log10(stars + 1e0) / 5) * 0.3e0)"""


@query(
    "sort_repos_composite",
    b.views("repositories", more=f"s AS (SELECT *, {b.TREND_SQL} AS trend_score FROM repositories)")
    + f"""SELECT ingest_seq, round({_COMPOSITE_SQL}, 6) AS composite,
          row_number() OVER (ORDER BY round({_COMPOSITE_SQL}, 9) DESC, stars DESC, id, ingest_seq) AS position FROM s""",
)
def _composite(spark, sf_dir):
    repos = b.repositories(spark, sf_dir).withColumn("trend_score", scores.trend_score(b.REPO_AS_OF))
    config = ordering.SortConfig("composite", "popularity", "desc", 0.2, 0.3, 0.3, 0.2)
    placed = with_position(repos, ordering.order_repos_by(config, b.REPO_AS_OF))
    return placed.select("ingest_seq", F.round(scores.repo_composite(b.REPO_AS_OF), 6).alias("composite"), "position")


@query(
    "process_repositories",
    b.views("repositories", more=f"s AS (SELECT *, {b.TREND_SQL} AS trend_score FROM repositories)")
    + """SELECT ingest_seq, round(trend_score, 6) AS trend_score FROM s ORDER BY round(trend_score, 9) ASC, id, ingest_seq LIMIT 25""",
)
def _process(spark, sf_dir):
    return personalize.process_repositories(
        b.repositories(spark, sf_dir), b.REPO_AS_OF, sort_by="trend", sort_order="asc", limit=25
    ).select("ingest_seq", F.round("trend_score", 6).alias("trend_score"))


@query(
    "render_order_repos",
    b.views("repositories")
    + "SELECT ingest_seq, row_number() OVER (ORDER BY lower(name), id, ingest_seq) AS position FROM repositories",
)
def _render_order(spark, sf_dir):
    repos = b.repositories(spark, sf_dir)
    order = ordering.order_for_render("repositories", "title", "asc")
    return with_position(repos, order).select("ingest_seq", "position")


@query(
    "personalize_repos",
    b.views("repositories", more=f"s AS (SELECT *, {b.TREND_SQL} AS trend_score FROM repositories)")
    + """SELECT ingest_seq, round(least(1e0, CASE WHEN lower(language) = 'javascript' THEN least(1e0, trend_score + 0.1e0) ELSE trend_score END
          + CASE WHEN contains(lower(name || ' ' || description || ' ' || full_name), 'react') THEN 0.05e0
                 WHEN contains(lower(name || ' ' || description || ' ' || full_name), 'tool') THEN 0.15e0 ELSE 0e0 END), 6) AS trend_score
        FROM s""",
)
def _personal(spark, sf_dir):
    repos = b.repositories(spark, sf_dir).withColumn("trend_score", scores.trend_score(b.REPO_AS_OF))
    prefs = personalize.Preferences(
        favorite_topics=["React", "tool"], topic_weights={"tool": 0.3}, languages=["javascript"]
    )
    return personalize.personalize_repos(repos, prefs).select(
        "ingest_seq", F.round("trend_score", 6).alias("trend_score")
    )


@query(
    "repository_feeds",
    b.views("repositories", "prefs", more=f"s AS (SELECT *, {b.TREND_SQL} AS trend_score FROM repositories)")
    + """SELECT reader_id, rank, ingest_seq AS id, topic, round(raised, 6) AS trend_score FROM (
           SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY raised DESC, trend_score DESC, ingest_seq)::INTEGER AS rank FROM (
             SELECT *, lower(name_) AS topic, least(1e0, base + CASE WHEN length(name_) = 3 THEN 0.125e0 ELSE 0.05e0 END) AS raised FROM (
               SELECT *, CASE WHEN lower(language) = ['javascript', 'go', 'css'][1 + reader_id % 3] THEN least(1e0, trend_score + 0.1e0) ELSE trend_score END AS base,
                 list_filter(topics, lambda t: contains(lower(name), lower(t)) OR contains(lower(description), lower(t)) OR contains(lower(full_name), lower(t)))[1] AS name_
               FROM prefs, s) WHERE name_ IS NOT NULL)) WHERE rank <= 20""",
)
def _feeds(spark, sf_dir):
    repos = b.repositories(spark, sf_dir).withColumn("trend_score", scores.trend_score(b.REPO_AS_OF))
    feeds = readers.repository_feeds(repos, b.preferences(spark, sf_dir), id_col="ingest_seq")
    return feeds.select("reader_id", "rank", "id", "topic", F.round("trend_score", 6).alias("trend_score"))


_PAGES = f"s AS (SELECT *, {b.TREND_SQL} AS trend_score FROM repositories)"


def _page_index(spark, sf_dir):
    repos = b.repositories(spark, sf_dir).withColumn("trend_score", scores.trend_score(b.REPO_AS_OF)).drop("metadata")
    folder = f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    return ordering.PageIndex.build(repos, ordering.order_for_render("repositories", "stars", "desc"), folder, block_rows=64)


@query(
    "pages_of_repositories",
    b.views("repositories", more=_PAGES)
    + """SELECT ingest_seq, round(trend_score, 6) AS trend_score, position FROM (
           SELECT *, row_number() OVER (ORDER BY stars DESC, id, ingest_seq) AS position FROM s)
         WHERE position BETWEEN 61 AND 90 OR position BETWEEN 151 AND 180""",
)
def _pages(spark, sf_dir):
    """Two pages, the first of which lies in two blocks of the index."""
    index = _page_index(spark, sf_dir)
    rows = index.page(3, 30).rows.unionByName(index.page(6, 30).rows)
    return rows.select("ingest_seq", F.round("trend_score", 6).alias("trend_score"), F.col("_position").alias("position"))


@query(
    "repository_page_totals",
    b.views("repositories")
    + """SELECT CAST(page AS BIGINT) AS current_page, CAST(30 AS BIGINT) AS page_size, total AS total_items, CAST(ceil(total / 30e0) AS BIGINT) AS total_pages,
           page < ceil(total / 30e0) AS has_next, page > 1 AS has_prev FROM (SELECT count(*) AS total FROM repositories), (VALUES (1), (5000)) AS p(page)""",
)
def _page_totals(spark, sf_dir):
    index = _page_index(spark, sf_dir)
    return index.page(1, 30).info.unionByName(index.page(5000, 30).info)
