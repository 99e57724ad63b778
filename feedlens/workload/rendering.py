"""Rendering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.functions import text as tx
from feedlens.operators import conform
from feedlens.plans.render import render, whole_result
from feedlens.plans.weekly import weekly_news
from feedlens.sinks import documents
from feedlens.sinks.settings import RenderSettings
from feedlens.workload import bindings as b
from feedlens.workload import sqltext as q
from feedlens.workload import topics
from feedlens.workload.articles import LEXICON, WEEKLY
from feedlens.workload.registry import query
from feedlens.workload.repos import TOP30, _ranked


def _md(expr: str) -> str:
    for old, new in [("&", "&amp;"), ("''", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")]:
        expr = f"replace({expr}, '{old}', '{new}')"
    for mark in ["\\", "*", "_", "`", "[", "]", "(", ")", "{", "}", "#", "+", "-", ".", "!", "|"]:
        expr = f"replace({expr}, '{mark}', '\\{mark}')"
    return expr


@query("escape_markdown", f"SELECT doc_id, md5({_md('text')}) AS escaped FROM documents")
def _escape(spark, sf_dir):
    return b.read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.escape_markdown("text")).alias("escaped"))


@query(
    "wrap_text",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)
       SELECT doc_id, md5(CASE WHEN len(ws) = 0 THEN '' ELSE list_reduce(list_transform(ws, lambda x: {'done': '', 'line': x}),
         lambda a, x: CASE WHEN strlen(a.line) + 1 + strlen(x.line) > 76 THEN {'done': a.done || a.line || chr(10) || '    ', 'line': x.line}
                           ELSE {'done': a.done, 'line': a.line || ' ' || x.line} END).done
         || list_reduce(list_transform(ws, lambda x: {'done': '', 'line': x}),
         lambda a, x: CASE WHEN strlen(a.line) + 1 + strlen(x.line) > 76 THEN {'done': '', 'line': x.line}
                           ELSE {'done': '', 'line': a.line || ' ' || x.line} END).line END) AS wrapped FROM w""",
)
def _wrap(spark, sf_dir):
    rows = b.read(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(tx.wrap(tx.display_text("text"), 76, "    ")).alias("wrapped"))


@query(
    "render_json_repositories",
    TOP30
    + """SELECT rank AS index, '{"description":"' || description || '","forks":' || forks || ',"fullName":"' || full_name || '","id":"' || id
         || '","language":"' || language || '","name":"' || name || '","stars":' || stars || ',"trendScore":' || round(trend_score, 6) || ',"updatedAt":"' || strftime(updated_at, '%Y-%m-%d %H:%M:%S')
         || '","url":"' || url || '"}' AS text FROM ranked""",
)
def _json(spark, sf_dir):
    repos = _ranked(spark, sf_dir).rows["repositories"]
    rows = documents.render_items(repos, "repositories", RenderSettings(), b.REPO_AS_OF)
    # a trend score has as many digits as a double needs, which the two engines spell differently
    score = F.round(F.get_json_object("text", "$.trendScore").cast("double"), 6).cast("string")
    return rows.withColumn("text", F.regexp_replace("text", F.lit('"trendScore":[0-9.E-]+,'), F.concat(F.lit('"trendScore":'), score, F.lit(","))))


@query(
    "render_text_repositories",
    TOP30
    + """SELECT rank AS index, '[' || rank || '] ' || full_name || chr(10) || CASE WHEN language <> '' THEN '    Language:    ' || language || chr(10) ELSE '' END
         || '    Stars:       ' || stars || chr(10) || '    Forks:       ' || forks || chr(10) || '    Trend Score: ' || printf('%.1f%%', trend_score * 100) || chr(10)
         || '    Updated:     ' || strftime(updated_at, '%Y-%m-%d %H:%M:%S') || chr(10) || '    URL:         ' || url || chr(10)
         || CASE WHEN description <> '' THEN chr(10) || '    Description:' || chr(10) || '    ' || description || chr(10) ELSE '' END
         || chr(10) || '    Status: ' || CASE WHEN stars >= 10000 THEN 'Viral' WHEN stars >= 1000 THEN 'Very Popular' WHEN stars >= 100 THEN 'Popular' WHEN stars >= 10 THEN 'Gaining Traction' ELSE 'New/Niche' END
         || ', ' || CASE WHEN age_us <= 604800000000 THEN 'Very Active' WHEN age_us <= 2592000000000 THEN 'Active' WHEN age_us <= 7776000000000 THEN 'Moderate Activity' ELSE 'Inactive' END
         || chr(10) || chr(10) AS text FROM ranked""",
)
def _text(spark, sf_dir):
    repos = _ranked(spark, sf_dir).rows["repositories"]
    return documents.render_items(repos, "repositories", RenderSettings(output="text"), b.REPO_AS_OF)


@query(
    "render_markdown_articles",
    WEEKLY
    + f"""SELECT rank AS index, '### ' || rank || '. [' || {_md("title")} || '](' || url || ')' || chr(10) || chr(10) || '| Field | Value |' || chr(10) || '|-------|-------|' || chr(10)
         || '| **Source** | ' || source || ' |' || chr(10) || '| **Type** | ' || source_type || ' |' || chr(10)
         || '| **Published** | ' || strftime(published_at, '%Y-%m-%d %H:%M:%S') || ' |' || chr(10)
         || CASE WHEN relevance > 0 THEN '| **Relevance** | ' || printf('%.1f%%', relevance * 100) || ' |' || chr(10) ELSE '' END
         || '| **Quality** | ' || printf('%.1f%%', quality * 100) || ' |' || chr(10) || chr(10)
         || CASE WHEN summary <> '' THEN '**Summary:**' || chr(10) || {_md(q.shorten("summary", 200))} || chr(10) || chr(10) ELSE '' END
         || '**Tags:** ' || array_to_string(list_transform(tags, lambda t: '`' || t || '`'), ', ') || chr(10) || chr(10)
         || '**Additional Metadata:**' || chr(10) || chr(10) || '- **author:** ' || author || chr(10) || '- **language:** ' || language || chr(10) || chr(10) AS text
         FROM ranked""",
)
def _markdown(spark, sf_dir):
    articles = weekly_news(conform.to_articles(b.articles(spark, sf_dir), b.AS_OF), b.AS_OF, lexicon=LEXICON).rows["articles"]
    settings = RenderSettings(output="markdown", metadata=True, max_summary=200)
    return documents.render_items(articles, "articles", settings, b.AS_OF)


_BATCHES = f"""
texts AS (
  SELECT *, array_to_string(list_filter(string_split_regex(replace(replace(title, '<', '&lt;'), '>', '&gt;'), '\\s+'), lambda x: x <> ''), ' ') AS shown,
    0.5e0 AS relevance, {b.QUALITY_SQL} AS quality, row_number() OVER (ORDER BY lower(title), id, ingest_seq) - 1 AS position FROM articles),
items AS (
  SELECT position // 500 AS batch, position % 500 + 1 AS index, (position % 500 + 1) || '. ' || shown || ' (' || url || ') [' || source || ']'
    || printf(' R:%.1f Q:%.1f', relevance * 100, quality * 100) || chr(10) || chr(10) AS text FROM texts)"""


@query(
    "render_batches",
    b.views("articles", more=_BATCHES)
    + """SELECT batch, count(*) AS items, md5('ARTICLES (' || count(*) || ' items)' || chr(10) || 'Generated: 2024-01-31 00:00:00' || chr(10) || chr(10) || string_agg(text, '' ORDER BY index)) AS digest FROM items GROUP BY batch""",
)
def _batches(spark, sf_dir):
    rows = conform.to_articles(b.articles(spark, sf_dir), b.AS_OF)
    settings = RenderSettings(output="text", compact=True, sort_by="title", sort_order="asc")
    return documents.render_batches(rows, "articles", settings, b.AS_OF).select("batch", "items", F.md5("body").alias("digest"))


@query(
    "format_timestamps",
    b.views("articles") + "SELECT id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS full_stamp, strftime(published_at, '%d/%m/%Y') AS day FROM articles",
)
def _stamps(spark, sf_dir):
    return b.articles(spark, sf_dir).select(
        "id", F.date_format("published_at", RenderSettings().date_format).alias("full_stamp"),
        F.date_format("published_at", "dd/MM/yyyy").alias("day"),
    )


for _output in ("json", "markdown", "text"):

    @query(f"render_topic_search_{_output}")
    def _mixed(spark, sf_dir, output=_output):
        return render(topics._search(spark, sf_dir), b.AS_OF, output)

    @query(f"render_trending_{_output}")
    def _one(spark, sf_dir, output=_output):
        return render(_ranked(spark, sf_dir), b.REPO_AS_OF, output)


# --- a whole result as JSON -------------------------------------------------------------


def _read_back(report, shape: str):
    return report.select(F.from_json("report", shape).alias("r"))


def _pairs(array: str, name: str = "name"):
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s[name], s["count"])), ",")


def _ids(entity: str):
    return F.array_join(F.col(f"r.{entity}.id"), ",")


_SOURCES = "(SELECT string_agg(name || ':' || c, ',' ORDER BY c DESC, name) FROM (SELECT {} AS name, count(*) AS c FROM {} GROUP BY 1))"


@query(
    "weekly_result_json",
    WEEKLY
    + f"""SELECT (SELECT string_agg(id, ',' ORDER BY rank) FROM ranked) AS ids, (SELECT count(*) FROM unique_articles) AS total,
         (SELECT count(*) FROM ranked) AS kept, '2024-01-24..2024-01-31/7' AS period, {_SOURCES.format("source", "unique_articles")} AS sources,
         (SELECT string_agg(title, chr(10) ORDER BY rank) FROM ranked) AS titles""",
)
def _weekly_json(spark, sf_dir):
    result = weekly_news(conform.to_articles(b.articles(spark, sf_dir), b.AS_OF), b.AS_OF, lexicon=LEXICON)
    shape = (
        "articles array<struct<id:string,title:string>>, totalCount long, filterCount long, "
        "period struct<start:string,end:string,days:int>, sources array<struct<name:string,count:long>>"
    )
    return _read_back(whole_result(result, b.AS_OF), shape).select(
        _ids("articles").alias("ids"),
        F.col("r.totalCount").alias("total"),
        F.col("r.filterCount").alias("kept"),
        F.format_string("%s..%s/%d", "r.period.start", "r.period.end", "r.period.days").alias("period"),
        _pairs("r.sources").alias("sources"),
        F.array_join("r.articles.title", "\n").alias("titles"),
    )


@query(
    "trending_result_json",
    TOP30
    + f"""SELECT (SELECT string_agg(id, ',' ORDER BY rank) FROM ranked) AS ids, (SELECT count(*) FROM ranked) AS kept, 'weekly' AS time_range,
         (SELECT CAST(sum(stars) AS BIGINT) FROM ranked) AS stars,
         {_SOURCES.format("CASE WHEN contains(url, 'gitlab') THEN 'GitLab' WHEN contains(url, 'bitbucket') THEN 'Bitbucket' ELSE 'GitHub' END", "ranked")} AS sources,
         (SELECT string_agg(name || ':' || c, ',' ORDER BY c DESC, name) FROM (
            SELECT language AS name, count(*) AS c FROM ranked WHERE language <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS languages""",
)
def _trending_json(spark, sf_dir):
    shape = (
        "repositories array<struct<id:string>>, filterCount long, timeRange string, sources array<struct<name:string,count:long>>, "
        "summary struct<totalStars:long, topLanguages:array<struct<name:string,count:long>>>"
    )
    return _read_back(whole_result(_ranked(spark, sf_dir), b.REPO_AS_OF, indent=False), shape).select(
        _ids("repositories").alias("ids"),
        F.col("r.filterCount").alias("kept"),
        F.col("r.timeRange").alias("time_range"),
        F.col("r.summary.totalStars").alias("stars"),
        _pairs("r.sources").alias("sources"),
        _pairs("r.summary.topLanguages").alias("languages"),
    )


@query(
    "topic_result_json",
    topics.SEARCH
    + """SELECT 'ention the javascript' AS query, (SELECT count(*) FROM top_a) AS articles, (SELECT count(*) FROM top_r) AS repositories,
         (SELECT count(*) FROM top_d) AS discussions,
         (SELECT count(*) FROM top_a) + (SELECT count(*) FROM top_r) + (SELECT count(*) FROM top_d) AS total,
         coalesce((SELECT string_agg(id || ':' || round(score, 6), ',' ORDER BY round(score, 9) DESC, id, ingest_seq) FROM top_a), '') AS article_ids,
         coalesce((SELECT string_agg(id || ':' || round(score, 6), ',' ORDER BY round(score, 9) DESC, id, ingest_seq) FROM top_r), '') AS repository_ids,
         coalesce((SELECT string_agg(id || ':' || round(score, 6) || ':' || md5(content), ',' ORDER BY round(score, 9) DESC, id, ingest_seq) FROM top_d), '') AS talks""",
)
def _topic_json(spark, sf_dir):
    shape = (
        "query string, articles array<struct<id:string,relevance:double>>, repositories array<struct<id:string,trendScore:double>>, "
        "discussions array<struct<id:string,relevance:double,content:string>>, totalResults long"
    )
    count = lambda entity: F.size(f"r.{entity}").cast("long").alias(entity)

    def listed(entity, score, *more):
        parts = lambda x: [x["id"], F.round(x[score], 6).cast("string"), *[F.md5(x[c]) for c in more]]
        return F.array_join(F.transform(f"r.{entity}", lambda x: F.concat_ws(":", *parts(x))), ",")

    return _read_back(whole_result(topics._search(spark, sf_dir), b.AS_OF), shape).select(
        F.col("r.query").alias("query"),
        count("articles"),
        count("repositories"),
        count("discussions"),
        F.col("r.totalResults").alias("total"),
        listed("articles", "relevance").alias("article_ids"),
        listed("repositories", "trendScore").alias("repository_ids"),
        listed("discussions", "relevance", "content").alias("talks"),
    )
