"""Article queries: weekly digest, conforming, scoring, filters and sorters."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.functions import scores
from feedlens.functions.identity import article_hash, article_id
from feedlens.operators import conform, filters, ordering, personalize, readers, reports
from feedlens.operators.dedup import dedup_articles, dedup_by_url, union_sources
from feedlens.operators.lexicon import lexicon_relevance
from feedlens.operators.sequence import with_position
from feedlens.plans.weekly import weekly_news
from feedlens.workload import bindings as b
from feedlens.workload.registry import query

# Frequent words of the given documents, as a lexicon for relevance.
LEXICON = {"the": 0.05, "and": 0.04, "of": 0.03, "les": 0.06, "que": 0.05, "der": 0.07, "und": 0.05, "en": 0.02}


def _conformed(spark, sf_dir):
    return conform.to_articles(b.articles(spark, sf_dir), b.AS_OF)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = f"translate(%s, '{_UPPER}', '{_UPPER.lower()}')"


def lexicon_sql(query_text: str = "") -> str:
    title, content = _FOLD % "title", _FOLD % "content"
    parts = [f"CASE WHEN contains({title}, '{w}') THEN {x * 1.5!r}e0 ELSE 0e0 END" for w, x in LEXICON.items()]
    parts += [f"CASE WHEN contains({content}, '{w}') THEN {x!r}e0 ELSE 0e0 END" for w, x in LEXICON.items()]
    parts += [f"len(list_filter(tags, lambda t: t = '{w}')) * {x * 1.2!r}e0" for w, x in LEXICON.items()]
    if query_text:
        parts.append(f"CASE WHEN contains({title}, '{query_text}') THEN 0.3e0 ELSE 0e0 END")
        parts.append(f"CASE WHEN contains({content}, '{query_text}') THEN 0.2e0 ELSE 0e0 END")
    return "least(1e0, " + " + ".join(parts) + ")"


def _weekly_cte(extra: str, start: str, end: str, query_text: str = "") -> str:
    return f"""
unique_articles AS (
  SELECT *, {b.QUALITY_SQL} AS quality FROM articles
  QUALIFY row_number() OVER (PARTITION BY md5(lower(title) || '|' || url) ORDER BY ingest_seq) = 1
),
kept AS (
  SELECT *, {lexicon_sql(query_text)} AS relevance FROM unique_articles
  WHERE published_at > TIMESTAMP '{start}' - INTERVAL 1 HOUR AND published_at < TIMESTAMP '{end}' + INTERVAL 1 HOUR
    {extra}
)"""


_WEEKLY = _weekly_cte("AND quality >= 0.5e0", "2024-01-24", "2024-01-31") + """,
ranked AS (
  SELECT *, row_number() OVER (ORDER BY round(relevance, 9) DESC, id) AS rank FROM kept
  QUALIFY rank <= 50
)"""
WEEKLY = b.views("articles", more=_WEEKLY)


def _weekly(spark, sf_dir, **settings):
    return weekly_news(_conformed(spark, sf_dir), b.AS_OF, lexicon=LEXICON, **settings)


@query(
    "weekly_news",
    WEEKLY
    + """SELECT id, title, url, source, source_type, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
         array_to_string(tags, ',') AS tags, round(quality, 6) AS quality, round(relevance, 6) AS relevance FROM ranked""",
)
def _weekly_default(spark, sf_dir):
    return _weekly(spark, sf_dir).rows["articles"].select(
        "id", "title", "url", "source", "source_type",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.array_join("tags", ",").alias("tags"),
        F.round("quality", 6).alias("quality"),
        F.round("relevance", 6).alias("relevance"),
    )


for _by, _order in {
    "quality": "round(quality, 9) DESC, id",
    "date": "published_at DESC, id",
    "title": "title, id",
}.items():

    @query(
        f"weekly_news_curated_by_{_by}",
        b.views(
            "articles",
            more=_weekly_cte(
                "AND quality >= 0.6e0 AND (list_contains(tags, 'curated') OR title || ' ' || summary = 'curated')",
                "2024-01-10", "2024-01-28", "curated",
            ),
        )
        + f"""SELECT id, round(quality, 6) AS quality, round(relevance, 6) AS relevance FROM kept
              ORDER BY {_order} LIMIT 200""",
    )
    def _weekly_curated(spark, sf_dir, by=_by):
        result = _weekly(
            spark, sf_dir, start="2024-01-10", end="2024-01-28", category="curated", min_quality=0.6,
            max_results=200, sort_by=by,
        )
        return result.rows["articles"].select(
            "id", F.round("quality", 6).alias("quality"), F.round("relevance", 6).alias("relevance")
        )


@query(
    "weekly_source_counts",
    WEEKLY
    + """SELECT source AS name, count(*) AS count, arg_max(source_type, ingest_seq) AS type
         FROM unique_articles GROUP BY 1""",
)
def _weekly_sources(spark, sf_dir):
    return _weekly(spark, sf_dir).reports["sources"]


@query(
    "weekly_topic_counts",
    WEEKLY
    + """SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM ranked)
         GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def _weekly_topics(spark, sf_dir):
    return _weekly(spark, sf_dir).reports["topics"]


@query(
    "weekly_totals",
    WEEKLY
    + """SELECT (SELECT count(*) FROM unique_articles) AS total_count, (SELECT count(*) FROM ranked) AS filter_count,
         CAST(7 AS BIGINT) AS days""",
)
def _weekly_totals(spark, sf_dir):
    return _weekly(spark, sf_dir).reports["totals"]


@query(
    "weekly_summary",
    WEEKLY
    + """, t AS (SELECT tag, count(*) AS c FROM (SELECT unnest(tags) AS tag FROM ranked) GROUP BY 1 HAVING count(*) >= 2
                 ORDER BY 2 DESC, 1 LIMIT 5)
         SELECT '在 2024-01-24 到 2024-01-31 期间，共收集到 ' || (SELECT count(*) FROM ranked) || ' 篇高质量前端开发新闻。'
           || ' 主要涉及话题：' || (SELECT string_agg(tag, '、' ORDER BY c DESC, tag) FROM t) || '。' AS summary""",
)
def _weekly_summary(spark, sf_dir):
    return _weekly(spark, sf_dir).reports["summary"]


# --- conform and score ------------------------------------------------------------------


@query(
    "conform_articles",
    b.views("articles")
    + f"""SELECT id, title, url, author, language, round({b.QUALITY_SQL}, 6) AS quality, 0.5e0 AS relevance,
          array_to_string(tags, ',') AS tags FROM articles""",
)
def _conform(spark, sf_dir):
    return _conformed(spark, sf_dir).select(
        "id", "title", "url",
        conform.get_metadata("metadata", "author").alias("author"),
        conform.get_metadata("metadata", "language").alias("language"),
        F.round("quality", 6).alias("quality"),
        "relevance",
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    "conform_repositories",
    b.views("articles")
    + """SELECT id, title AS name, summary AS description, language, ingest_seq % 1500 AS stars,
           CASE WHEN ingest_seq % 2 = 0 THEN ingest_seq % 60 ELSE 0 END AS forks,
           round(least(1e0,
             CASE WHEN ingest_seq % 1500 >= 1000 THEN 0.4e0 WHEN ingest_seq % 1500 >= 100 THEN 0.3e0
                  WHEN ingest_seq % 1500 >= 10 THEN 0.2e0 WHEN ingest_seq % 1500 > 0 THEN 0.1e0 ELSE 0e0 END
             + CASE WHEN ingest_seq % 2 = 1 OR ingest_seq % 60 = 0 THEN 0e0 WHEN ingest_seq % 60 >= 10 THEN 0.15e0 ELSE 0.1e0 END
             + CASE WHEN age_hours <= 720 THEN 0.2e0 ELSE 0e0 END + CASE WHEN age_hours <= 168 THEN 0.1e0 ELSE 0e0 END
             + CASE WHEN trim(summary) <> '' THEN 0.1e0 ELSE 0e0 END), 6) AS trend_score
         FROM articles""",
)
def _conform_repos(spark, sf_dir):
    seq = F.col("ingest_seq")
    forks = F.when(seq % 2 == 0, (seq % 60).cast("string")).otherwise("many")
    raw = b.articles(spark, sf_dir).withColumn(
        "metadata", F.create_map(F.lit("stars"), (seq % 1500).cast("string"), F.lit("forks"), forks)
    )
    return conform.to_repositories(raw, b.AS_OF).select(
        "id", "name", "description", "language", "stars", "forks", F.round("trend_score", 6).alias("trend_score")
    )


@query(
    "article_quality",
    b.views("articles") + f"SELECT id, round({b.QUALITY_SQL}, 6) AS quality FROM articles",
)
def _quality(spark, sf_dir):
    return b.articles(spark, sf_dir).select("id", F.round(scores.quality_score(b.AS_OF), 6).alias("quality"))


@query(
    "article_ids",
    b.views("articles")
    + """SELECT ingest_seq, md5(url || '|' || title) AS id, md5(lower(title) || '|' || url) AS hash,
         md5(lower(trim(title)) || '|' || trim(url)) AS trimmed_hash FROM articles""",
)
def _ids(spark, sf_dir):
    return b.articles(spark, sf_dir).select(
        "ingest_seq", article_id().alias("id"), article_hash().alias("hash"),
        article_hash(trimmed=True).alias("trimmed_hash"),
    )


@query(
    "article_measures",
    b.views("articles")
    + """SELECT id, length(title) AS title_length, length(summary) AS summary_length,
         list_contains(tags, 'curated') AS curated FROM articles""",
)
def _measures(spark, sf_dir):
    columns = [c.alias(n) for n, c in conform.article_measures().items()]
    return b.articles(spark, sf_dir).select("id", *columns, conform.has_tag("tags", " Curated ").alias("curated"))


@query(
    "validate_articles",
    b.views("articles")
    + """SELECT CASE WHEN trim(title) = '' THEN 'Title is required' WHEN strlen(title) > 500 THEN 'Title must not exceed 500 characters'
              WHEN source_type NOT IN ('rss', 'api', 'html') THEN 'SourceType must be one of: [rss api html]'
              WHEN summary <> '' AND strlen(summary) < 10 THEN 'Summary must be at least 10 characters' ELSE '' END AS error,
         count(*) AS rows FROM articles GROUP BY 1""",
)
def _validate(spark, sf_dir):
    return conform.error_summary(conform.validate_articles(_conformed(spark, sf_dir)))


@query(
    "article_metadata",
    b.views("articles")
    + """SELECT id, author, language, 'fr' = language AS french,
         CASE WHEN ingest_seq % 2 = 0 THEN 'replaced' ELSE author END AS author_after FROM articles""",
)
def _metadata(spark, sf_dir):
    rows = _conformed(spark, sf_dir)
    changed = conform.set_metadata("metadata", "author", F.lit("replaced"))
    after = F.when(F.col("ingest_seq") % 2 == 0, changed).otherwise(F.col("metadata"))
    return rows.select(
        "id",
        conform.get_metadata("metadata", "author").alias("author"),
        conform.get_metadata("metadata", "language").alias("language"),
        (conform.get_metadata("metadata", "language") == "fr").alias("french"),
        conform.get_metadata(after, "author").alias("author_after"),
    )


@query(
    "lexicon_relevance",
    b.views("articles") + f"SELECT id, round({lexicon_sql('den')}, 6) AS relevance FROM articles",
)
def _lexicon(spark, sf_dir):
    return lexicon_relevance(b.articles(spark, sf_dir), "den", LEXICON).select(
        "id", F.round("relevance", 6).alias("relevance")
    )


@query(
    "normalize_time",
    """SELECT event_id, strftime(ts::TIMESTAMP AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc FROM events""",
)
def _times(spark, sf_dir):
    """The local times of the events, read as New York's, in UTC."""
    rows = b.read(spark, sf_dir, "events")
    return rows.select("event_id", F.date_format(conform.normalize_time("ts", "America/New_York"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query(
    "add_tags",
    b.views("articles")
    + """SELECT id, array_to_string(list_concat(tags, list_filter(['web', 'en', 'curated'], lambda t: NOT list_contains(tags, t))), ',') AS tags,
           list_contains(tags, 'en') AS english FROM articles""",
)
def _added(spark, sf_dir):
    tags = conform.add_tags("tags", [" Web", "EN", "", "curated"])
    return b.articles(spark, sf_dir).select("id", F.array_join(tags, ",").alias("tags"), conform.has_tag("tags", " En ").alias("english"))


# --- filters ----------------------------------------------------------------------------


@query(
    "filter_articles",
    b.views("articles")
    + """SELECT id FROM articles WHERE (contains(title, 'the') OR contains(content, 'the') OR contains(title, 'des') OR contains(content, 'des'))
           AND (contains(author, '1') OR contains(author, '3'))
           AND len(list_filter(tags, lambda t: contains(t, 'cur') OR contains(t, 'fr'))) > 0
           AND language IN ('en', 'fr') AND published_at BETWEEN TIMESTAMP '2023-12-25' AND TIMESTAMP '2024-01-30'
           AND strlen(content) BETWEEN 200 AND 9000""",
)
def _filter(spark, sf_dir):
    rule = filters.ArticleFilter(
        keywords=["the", "des"], authors=["1", "3"], tags=["cur", "fr"], languages=["en", "fr"],
        date_from="2023-12-25", date_to="2024-01-30", min_length=200, max_length=9000,
    )
    return filters.filter_articles(b.articles(spark, sf_dir), rule).select("id")


@query(
    "filter_period",
    b.views("articles")
    + """SELECT id FROM articles WHERE published_at > TIMESTAMP '2024-01-04 23:00:00'
         AND published_at < TIMESTAMP '2024-01-20 01:00:00'""",
)
def _period(spark, sf_dir):
    period = filters.resolve_period(b.AS_OF, "2024-01-05", "2024-01-20")
    return filters.filter_period(b.articles(spark, sf_dir), period).select("id")


@query(
    "filter_category_substring",
    b.views("articles")
    + """SELECT id FROM articles WHERE list_contains(tags, 'typescript')
         OR regexp_matches(title || ' ' || summary, 'typescript|ts|type|interface')""",
)
def _category(spark, sf_dir):
    rows = filters.filter_category_articles(b.articles(spark, sf_dir), "typescript", "substring")
    return rows.select("id")


@query(
    "filter_category_tag",
    b.views("articles")
    + "SELECT id FROM articles WHERE list_contains(tags, 'de') OR title || ' ' || summary = 'de'",
)
def _category_tag(spark, sf_dir):
    return filters.filter_category_articles(b.articles(spark, sf_dir), "de").select("id")


@query(
    "filter_min_quality",
    b.views("articles") + f"SELECT id FROM articles WHERE {b.QUALITY_SQL} >= 0.7e0",
)
def _min_quality(spark, sf_dir):
    return filters.filter_min_quality(_conformed(spark, sf_dir), 0.7).select("id")


# --- de-duplication and union -----------------------------------------------------------


@query(
    "dedup_articles",
    """WITH d AS (SELECT doc_id, md5(lower(left(split_part(text, chr(10), 1), 120)) || '|' || source) AS key FROM documents)
       SELECT key, min(doc_id) AS ingest_seq, count(*) > 1 AS had_copies FROM d GROUP BY key""",
)
def _dedup(spark, sf_dir):
    rows = b.articles(spark, sf_dir).withColumn("url", F.col("source"))
    copies = rows.groupBy(article_hash().alias("key")).agg((F.count(F.lit(1)) > 1).alias("had_copies"))
    kept = dedup_articles(rows).select(article_hash().alias("key"), "ingest_seq")
    return kept.join(copies, "key").select("key", "ingest_seq", "had_copies")


@query(
    "dedup_by_url",
    b.views("articles")
    + """SELECT CASE WHEN ingest_seq % 3 = 0 THEN id ELSE source END AS key, min(ingest_seq) AS ingest_seq
         FROM articles GROUP BY 1""",
)
def _dedup_url(spark, sf_dir):
    url = F.when(F.col("ingest_seq") % 3 == 0, "").otherwise(F.col("source"))
    rows = dedup_by_url(b.articles(spark, sf_dir).withColumn("url", url))
    return rows.select(F.when(F.col("url") == "", F.col("id")).otherwise(F.col("url")).alias("key"), "ingest_seq")


@query(
    "union_sources",
    b.views("articles")
    + """SELECT source_type AS source, CASE WHEN source_type = 'html' AND ingest_seq % 5 = 0
              THEN 'source html: empty body' ELSE '' END AS error, count(*) AS rows FROM articles GROUP BY 1, 2""",
)
def _union(spark, sf_dir):
    rows = b.articles(spark, sf_dir)
    parts = {kind: rows.where(F.col("source_type") == kind) for kind in ("rss", "api")}
    parts["html"] = rows.where(F.col("source_type") == "html").withColumn(
        "error", F.when(F.col("ingest_seq") % 5 == 0, "empty body")
    )
    good, bad = union_sources(parts)
    ok = good.groupBy(F.col("source_type").alias("source"), F.lit("").alias("error")).agg(reports.rows().alias("rows"))
    return ok.unionByName(bad.groupBy("source", "error").agg(reports.rows().alias("rows")))


# --- sorters, pages, preferences --------------------------------------------------------

_TREND = """least(1e0, quality * 0.4e0 + CASE WHEN age_hours <= 24 THEN 0.6e0
   WHEN age_hours <= 168 THEN 0.4e0 * (1e0 - (age_hours - 24) / 144e0)
   WHEN age_hours <= 720 THEN 0.2e0 * (1e0 - (age_hours - 168) / 552e0) ELSE 0e0 END)"""
_DECAY = "exp(-0.01e0 * age_hours)"
_COMPOSITE = f"(relevance * 0.4e0 + {_DECAY} * 0.3e0 + quality * 0.2e0 + {_TREND} * 0.1e0)"
_SCORED = f"s AS (SELECT *, {b.QUALITY_SQL} AS quality, {lexicon_sql()} AS relevance FROM articles)"


def _scored(spark, sf_dir):
    return lexicon_relevance(_conformed(spark, sf_dir), "", LEXICON)


@query(
    "article_ranking_scores",
    b.views("articles", more=_SCORED)
    + f"""SELECT id, round({_TREND}, 6) AS trend, round({_DECAY}, 6) AS decay, round({_COMPOSITE}, 6) AS composite FROM s""",
)
def _ranking(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "id",
        F.round(scores.article_trend(b.AS_OF), 6).alias("trend"),
        F.round(scores.time_decay(b.AS_OF), 6).alias("decay"),
        F.round(scores.composite_score(b.AS_OF), 6).alias("composite"),
    )


for _name, _config, _order in [
    ("composite", ordering.SortConfig(), f"round({_COMPOSITE}, 9) DESC, published_at DESC, id"),
    ("trend_time_asc", ordering.SortConfig("trend", "time", "asc"), f"round({_TREND}, 9), published_at, id"),
    ("popularity_relevance", ordering.SortConfig("popularity", "relevance"), "round(quality, 9) DESC, round(relevance, 9) DESC, id"),
]:

    @query(
        f"sort_articles_{_name}",
        b.views("articles", more=_SCORED)
        + f"SELECT id, row_number() OVER (ORDER BY {_order}) AS position FROM s",
    )
    def _sort(spark, sf_dir, config=_config):
        order = ordering.order_articles_by(config, b.AS_OF)
        return with_position(_scored(spark, sf_dir).drop("content"), order).select("id", "position")


for _by, _asc, _order in [
    ("date", True, "published_at, ingest_seq"),
    ("title", False, "title DESC, ingest_seq"),
    ("author", True, "author, ingest_seq"),
    ("arrival", False, "ingest_seq"),
]:

    @query(
        f"order_articles_by_{_by}",
        b.views("articles")
        + f"SELECT id, row_number() OVER (ORDER BY {_order}) AS position FROM articles",
    )
    def _order_by(spark, sf_dir, by=_by, ascending=_asc):
        order = ordering.order_articles(by, ascending)
        return with_position(b.articles(spark, sf_dir).drop("content"), order).select("id", "position")


for _by, _dir, _order in [
    ("relevance", "desc", "round(relevance, 9) DESC, id"),
    ("quality", "asc", "round(quality, 9), id"),
    ("date", "desc", "published_at DESC, id"),
    ("title", "asc", "lower(title), id"),
]:

    @query(
        f"render_order_articles_{_by}",
        b.views("articles", more=_SCORED)
        + f"SELECT id, row_number() OVER (ORDER BY {_order}) AS position FROM s",
    )
    def _render_order(spark, sf_dir, by=_by, direction=_dir):
        order = ordering.order_for_render("articles", by, direction)
        return with_position(_scored(spark, sf_dir).drop("content"), order).select("id", "position")


@query(
    "page_of_articles",
    b.views("articles", more=_SCORED)
    + f"SELECT id, round({_COMPOSITE}, 6) AS composite FROM s ORDER BY round({_COMPOSITE}, 9) DESC, published_at DESC, id LIMIT 25 OFFSET 50",
)
def _page(spark, sf_dir):
    order = ordering.order_articles_by(ordering.ARTICLE_SORT, b.AS_OF)
    page = ordering.paginate(_scored(spark, sf_dir), order, page=3, size=25)
    return page.rows.select("id", F.round(scores.composite_score(b.AS_OF), 6).alias("composite"))


@query(
    "page_totals",
    """SELECT CAST(3 AS BIGINT) AS current_page, CAST(25 AS BIGINT) AS page_size, count(*) AS total_items,
       CAST(ceil(count(*) / 25e0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 25e0) AS has_next, true AS has_prev
       FROM documents""",
)
def _page_totals(spark, sf_dir):
    return ordering.paginate(b.articles(spark, sf_dir), [F.col("id").asc()], page=3, size=25).info


@query(
    "personalize_articles",
    b.views("articles", more=_SCORED)
    + f"""SELECT id,
           round(least(1e0, CASE WHEN source IN ('src3', 'src7') THEN least(1e0, quality + 0.1e0) ELSE quality END
                 + {_DECAY} * 0.6e0 * 0.1e0), 6) AS quality,
           round(least(1e0, relevance
             + CASE WHEN contains(lower(title), 'den') OR contains(lower(summary), 'den') OR len(list_filter(tags, lambda t: contains(lower(t), 'den'))) > 0 THEN 0.25e0
                    WHEN contains(lower(title), 'cur') OR contains(lower(summary), 'cur') OR len(list_filter(tags, lambda t: contains(lower(t), 'cur'))) > 0 THEN 0.1e0
                    ELSE 0e0 END), 6) AS relevance FROM s""",
)
def _personal(spark, sf_dir):
    prefs = personalize.Preferences(
        favorite_topics=["Den", "cur"], preferred_sources=["src3", "src7"], topic_weights={"Den": 0.25}, recency=0.6
    )
    return personalize.personalize_articles(_scored(spark, sf_dir), prefs, b.AS_OF).select(
        "id", F.round("quality", 6).alias("quality"), F.round("relevance", 6).alias("relevance")
    )


@query(
    "article_feeds",
    b.views("articles", "prefs", more=_SCORED)
    + f"""SELECT reader_id, rank, id, topic, round(raised, 6) AS relevance, round(q, 6) AS quality FROM (
           SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY raised DESC, relevance DESC, id)::INTEGER AS rank FROM (
             SELECT reader_id, id, topic, relevance, least(1e0, relevance + CASE WHEN length(topic) = 3 THEN 0.25e0 ELSE 0.1e0 END) AS raised,
               CASE WHEN reader_id % 10 > 0 THEN least(1e0, base + {_DECAY} * (reader_id % 10) / 10e0 * 0.1e0) ELSE base END AS q
             FROM (
               SELECT *, CASE WHEN source = 'src' || (reader_id % 20) THEN least(1e0, quality + 0.1e0) ELSE quality END AS base,
                 list_filter(topics, lambda t: contains(lower(title), lower(t)) OR contains(lower(summary), lower(t))
                   OR list_contains(list_transform(tags, lambda g: contains(lower(g), lower(t))), true))[1] AS name, lower(name) AS topic
               FROM prefs, (SELECT * REPLACE (round(0.3e0 + ingest_seq % 97 / 140e0, 9) AS relevance) FROM s))
             WHERE name IS NOT NULL)) WHERE rank <= 20""",
)
def _feeds(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("relevance", F.round(0.3 + F.col("ingest_seq") % 97 / F.lit(140.0), 9))
    feeds = readers.article_feeds(rows, b.preferences(spark, sf_dir), b.AS_OF)
    return feeds.select("reader_id", "rank", "id", "topic", F.round("relevance", 6).alias("relevance"), F.round("quality", 6).alias("quality"))
