"""Feed and API payloads built from the given tables, and the source catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions.text import replace_all
from feedlens.functions.times import at
from feedlens.operators import conform, reports
from feedlens.sources import api, catalog, feeds, registry
from feedlens.workload import bindings as b
from feedlens.workload import sqltext as q
from feedlens.workload.registry import query


def _xml(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return replace_all(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def _payload(df, url: Column, body: Column, seq: Column):
    return df.select(
        url.alias("source_url"),
        body.alias("body"),
        F.array(F.lit("landed")).alias("config_tags"),
        F.lit("en").alias("config_language"),
        F.create_map(F.lit("batch"), F.lit("b1")).alias("config_metadata"),
        at(b.AS_OF).alias("fetched_at"),
        seq.alias("payload_seq"),
    )


def rss_payloads(spark, sf_dir):
    """A feed of two items per document; the second has neither guid nor category."""
    docs = b.articles(spark, sf_dir)
    stamp = F.date_format("published_at", "dd MMM yyyy HH:mm:ss")
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title><item><title>'),
        _xml("title"), F.lit("</title><description>"), _xml("content"), F.lit("</description><link>"), F.col("url"),
        F.lit("</link><guid>doc-"), F.col("id"), F.lit("</guid><pubDate>Mon, "), stamp,
        F.lit(" GMT</pubDate><author>"), _xml("author"), F.lit("</author><category>"), F.col("language"),
        F.lit("</category></item><item><title>Second</title><link>"), F.col("url"),
        F.lit("/2</link><pubDate>Tue, "), stamp, F.lit(" +0200</pubDate></item></channel></rss>"),
    )
    return _payload(docs, F.concat(F.col("source"), F.lit(".example.com/rss")), body, F.col("ingest_seq"))


@query(
    "parse_rss",
    b.views("articles", more=f"t AS (SELECT *, {q.tidy('content')} AS body FROM articles)")
    + f"""SELECT 'doc-' || id AS id, trim(title) AS title, md5(body) AS digest, {q.shorten("body", 200)} AS summary, author, url,
            strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, language || ',landed' AS tags,
            ingest_seq * 1000000 AS ingest_seq FROM t
          UNION ALL
          SELECT left(sha256(url || '/2' || 'Second'), 16), 'Second', md5(''), '', '', url || '/2',
            strftime(published_at - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S'), 'landed', ingest_seq * 1000000 + 1 FROM t""",
)
def _rss(spark, sf_dir):
    return _shown(feeds.parse_rss(rss_payloads(spark, sf_dir)))


def _shown(rows):
    return rows.select(
        "id", "title", F.md5("content").alias("digest"), "summary", "author", "url",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.array_join("tags", ",").alias("tags"), "ingest_seq",
    )


def atom_payloads(spark, sf_dir):
    """A feed of one entry per document; its first link is not the alternate one."""
    docs = b.articles(spark, sf_dir)
    stamp = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    body = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title><entry><id>urn:'), F.col("id"),
        F.lit('</id><title>'), _xml("title"), F.lit('</title><link href="/self" rel="self"/><link href="'), F.col("url"),
        F.lit('" rel="alternate"/><content type="text">'), _xml("content"), F.lit("</content><summary>"),
        _xml("summary"), F.lit("</summary><updated>"), stamp, F.lit("Z</updated><author><name>"), _xml("author"),
        F.lit('</name></author><category term="'), F.col("language"), F.lit('"/><category term="web"/></entry></feed>'),
    )
    return _payload(docs, F.concat(F.col("source"), F.lit(".example.com/atom")), body, F.col("ingest_seq"))


@query(
    "parse_atom",
    b.views("articles", more=f"t AS (SELECT * REPLACE ({q.tidy('summary')} AS summary), {q.tidy('content')} AS body FROM articles)")
    + f"""SELECT 'urn:' || id AS id, trim(title) AS title, md5(body) AS digest, {q.shorten("summary", 200)} AS summary, author, url,
            strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, language || ',web,landed' AS tags,
            ingest_seq * 1000000 AS ingest_seq FROM t""",
)
def _atom(spark, sf_dir):
    return _shown(feeds.parse_atom(atom_payloads(spark, sf_dir)))


def repo_payloads(spark, sf_dir):
    """A search result of one repository per part; odd ones come as a bare list."""
    repos = b.repositories(spark, sf_dir)
    seq = F.col("ingest_seq")
    item = F.struct(
        seq.alias("id"), F.col("name"), F.col("full_name"), F.col("description"), F.col("url").alias("html_url"),
        F.col("language"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.col("stars").alias("stargazers_count"), F.col("forks").alias("forks_count"), (seq % 10 == 0).alias("fork"),
        F.struct(F.split("full_name", "/")[0].alias("login")).alias("owner"),
        F.array(F.lit("frontend"), F.lower("language")).alias("topics"),
    )
    searched = seq % 2 == 0
    url = F.when(searched, "https://api.github.com/search/repositories?q=x").otherwise("https://api.github.com/users/x/repos")
    body = F.when(searched, F.to_json(F.struct(F.array(item).alias("items")))).otherwise(F.to_json(F.array(item)))
    return _payload(repos, url, body, seq)


@query(
    "parse_github_repos",
    b.views("repositories")
    + """SELECT CAST(ingest_seq AS VARCHAR) AS id, full_name AS title, md5(description) AS digest, description AS summary,
           split_part(full_name, '/', 1) AS author, url, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS published_at,
           'frontend,' || lower(language) || ',landed' AS tags, ingest_seq * 1000000 AS ingest_seq,
           CAST(stars AS VARCHAR) AS stars, CAST(forks AS VARCHAR) AS forks, CASE WHEN is_fork THEN 'true' ELSE 'false' END AS is_fork,
           language, 'b1' AS batch
         FROM repositories""",
)
def _repos(spark, sf_dir):
    rows = api.parse_github_repos(repo_payloads(spark, sf_dir))
    extra = [conform.get_metadata("metadata", k).alias(k) for k in ("stars", "forks", "is_fork", "batch")]
    return _shown_with(rows, extra + [F.col("language")])


def _shown_with(rows, extra):
    return rows.select(
        "id", "title", F.md5("content").alias("digest"), "summary", "author", "url",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.array_join("tags", ",").alias("tags"), "ingest_seq", *extra,
    )


def issue_payloads(spark, sf_dir):
    """A list of one issue per order."""
    orders = b.read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    item = F.struct(
        key.alias("id"), (key % 1000).alias("number"), F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("title"),
        F.repeat(F.concat(F.lit("status "), F.col("o_orderstatus"), F.lit(" ")), (key % 60).cast("int")).alias("body"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"),
        F.concat(F.lit("https://code.example.com/issues/"), key.cast("string")).alias("html_url"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.struct(F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("login")).alias("user"),
        F.array(F.struct(F.lower("o_orderpriority").alias("name"))).alias("labels"),
    )
    return _payload(orders, F.lit("https://api.github.com/repos/a/b/issues"), F.to_json(F.array(item)), key)


_ISSUE_BODY = "repeat('status ' || o_orderstatus || ' ', CAST(o_orderkey % 60 AS INTEGER))"


@query(
    "parse_github_issues",
    f"""WITH o AS (SELECT *, {_ISSUE_BODY} AS body FROM orders)
        SELECT CAST(o_orderkey AS VARCHAR) AS id, '#' || (o_orderkey % 1000) || ': Order ' || o_orderpriority AS title,
          md5(body) AS digest, {q.shorten("body", 200)} AS summary, 'user' || o_custkey AS author,
          'https://code.example.com/issues/' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS published_at,
          'github-issue,' || CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END || ',' || lower(o_orderpriority) || ',landed' AS tags,
          o_orderkey * 1000000 AS ingest_seq, CAST(o_orderkey % 1000 AS VARCHAR) AS issue_number FROM o""",
)
def _issues(spark, sf_dir):
    rows = api.parse_github_issues(issue_payloads(spark, sf_dir))
    return _shown_with(rows, [conform.get_metadata("metadata", "issue_number").alias("issue_number")])


def post_payloads(spark, sf_dir):
    """A list of one post per document; every third belongs to an organisation."""
    docs = b.articles(spark, sf_dir)
    seq = F.col("ingest_seq")
    item = F.struct(
        seq.alias("id"), F.col("title"), F.col("summary").alias("description"), F.col("content").alias("body_markdown"),
        F.col("url"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+01:00'").alias("published_at"),
        F.col("tags").alias("tag_list"),
        F.struct(F.lit("login").alias("username"), F.when(seq % 5 == 0, "").otherwise(F.col("author")).alias("name")).alias("user"),
        F.when(seq % 3 == 0, F.struct(F.lit("Org").alias("name"))).alias("organization"),
        (seq % 12).alias("reading_time_minutes"),
    )
    return _payload(docs, F.lit("https://dev.to/api/articles?tag=x"), F.to_json(F.array(item)), seq)


@query(
    "parse_devto_articles",
    b.views("articles")
    + """SELECT id, title, md5(content) AS digest, summary,
           CASE WHEN ingest_seq % 3 = 0 THEN 'Org' WHEN ingest_seq % 5 = 0 THEN 'login' ELSE author END AS author, url,
           strftime(published_at - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS published_at,
           array_to_string(tags, ',') || ',landed' AS tags, ingest_seq * 1000000 AS ingest_seq,
           CAST(ingest_seq % 12 AS VARCHAR) AS minutes FROM articles""",
)
def _posts(spark, sf_dir):
    rows = api.parse_devto_articles(post_payloads(spark, sf_dir))
    return _shown_with(rows, [conform.get_metadata("metadata", "reading_time_minutes").alias("minutes")])


def generic_payloads(spark, sf_dir):
    docs = b.articles(spark, sf_dir)
    return _payload(docs, F.concat(F.col("url"), F.lit("/api/x")), F.col("content"), F.col("ingest_seq"))


@query(
    "parse_generic_api",
    b.views("articles")
    + """SELECT left(sha256(url || '/api/x'), 16) AS id, 'API Response from ' || url || '/api/x' AS title, md5(content) AS digest,
           'API response containing ' || strlen(content) || ' bytes of data' AS summary, 'API' AS author, url || '/api/x' AS url,
           '2024-01-31 00:00:00' AS published_at, 'api,landed' AS tags, ingest_seq * 1000000 AS ingest_seq FROM articles""",
)
def _generic(spark, sf_dir):
    return _shown(api.parse_generic_api(generic_payloads(spark, sf_dir)))


@query(
    "parse_mixed_payloads",
    """SELECT 'api' AS source_type, (SELECT count(*) FROM orders) + (SELECT count(*) FROM documents)
         + (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN part ON l_partkey = p_partkey) AS rows
       UNION ALL SELECT 'rss', 3 * count(*) FROM documents""",
)
def _mixed(spark, sf_dir):
    payloads = rss_payloads(spark, sf_dir)
    for more in (atom_payloads, issue_payloads, post_payloads, repo_payloads):
        payloads = payloads.unionByName(more(spark, sf_dir))
    rows = registry.parse_payloads(payloads)
    return rows.groupBy("source_type").agg(reports.rows().alias("rows"))


@query(
    "cap_per_source",
    b.views("articles") + "SELECT ingest_seq * 1000000 AS ingest_seq FROM articles",
)
def _cap(spark, sf_dir):
    items = feeds.parse_rss(rss_payloads(spark, sf_dir))
    return catalog.cap_per_source(items, 1).select("ingest_seq")


# --- catalogue --------------------------------------------------------------------------

_URLS = """
urls AS (
  SELECT page_id, CASE page_id % 8 WHEN 0 THEN url || '/rss' WHEN 1 THEN 'https://api.github.com/' || page_id WHEN 2 THEN url || '/feed.xml'
           WHEN 3 THEN 'ftp://files.example.com/' || page_id WHEN 4 THEN '' WHEN 5 THEN url || '/api/v1' WHEN 6 THEN ':bad' || page_id
           ELSE url END AS url, page_id % 16 = 7 AS typed FROM pages
)"""


def _urls(spark, sf_dir):
    page, url = F.col("page_id"), F.col("url")
    made = (
        F.when(page % 8 == 0, F.concat(url, F.lit("/rss")))
        .when(page % 8 == 1, F.concat(F.lit("https://api.github.com/"), page.cast("string")))
        .when(page % 8 == 2, F.concat(url, F.lit("/feed.xml")))
        .when(page % 8 == 3, F.concat(F.lit("ftp://files.example.com/"), page.cast("string")))
        .when(page % 8 == 4, "")
        .when(page % 8 == 5, F.concat(url, F.lit("/api/v1")))
        .when(page % 8 == 6, F.concat(F.lit(":bad"), page.cast("string")))
        .otherwise(url)
    )
    typed = F.when(page % 16 == 7, F.create_map(F.lit("source_type"), F.lit("rss")))
    return b.read(spark, sf_dir, "pages").select("page_id", made.alias("url"), typed.alias("metadata"))


@query(
    "classify_source_type",
    b.views(more=_URLS)
    + """SELECT page_id, CASE WHEN typed THEN 'rss' WHEN regexp_matches(url, '\\.xml|/rss|/feed|/atom') THEN 'rss'
         WHEN regexp_matches(url, 'api\\.github\\.com|dev\\.to/api|/api/') THEN 'api' ELSE 'html' END AS kind FROM urls""",
)
def _classify(spark, sf_dir):
    rows = _urls(spark, sf_dir)
    return rows.select("page_id", catalog.classify_source_type("url", "metadata").alias("kind"))


@query(
    "source_url_errors",
    b.views(more=_URLS)
    + """SELECT page_id, CASE WHEN url = '' THEN 'URL is required' WHEN starts_with(url, ':') THEN 'invalid URL'
         WHEN NOT regexp_matches(url, '^https?:') THEN 'URL must use http or https scheme' ELSE '' END AS error FROM urls""",
)
def _url_errors(spark, sf_dir):
    error = F.coalesce(catalog.source_url_error("url"), F.lit(""))
    return _urls(spark, sf_dir).select("page_id", error.alias("error"))


@query(
    "fetch_errors",
    """WITH log AS (SELECT 's' || (user_id % 20) AS source,
         CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'HTTP error 404' WHEN 1 THEN 'timeout' WHEN 2 THEN 'validation failed: URL'
              WHEN 3 THEN 'HTTP error 503' ELSE 'odd' END END AS error FROM events)
       SELECT source, count(*) AS failures, count(*) FILTER (WHERE NOT regexp_matches(error, '404|validation failed')) AS retryable,
         count(*) FILTER (WHERE regexp_matches(error, '404|validation failed')) AS final
       FROM log WHERE error IS NOT NULL GROUP BY 1""",
)
def _fetch_errors(spark, sf_dir):
    texts = F.array(*[F.lit(t) for t in ("HTTP error 404", "timeout", "validation failed: URL", "HTTP error 503", "odd")])
    log = b.read(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("source"),
        F.when(F.col("event_type") == "error", F.get(texts, (F.col("event_id") % 5).cast("int"))).alias("error"),
    )
    return catalog.classify_fetch_errors(log)


@query(
    "resolve_sources",
    """WITH catalog(name, n) AS (VALUES ('dev.to', 0), ('dev.to-react', 1), ('dev.to-vue', 2), ('dev.to-javascript', 3)),
       wanted AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'dev.to, unknown,dev.to-vue' WHEN 2 THEN 'dev.to-vue,dev.to-vue' ELSE ' , x' END AS s FROM events),
       listed AS (SELECT event_id, trim(unnest(string_split(s, ','))) AS name FROM wanted WHERE s <> '')
       SELECT name, max_articles, count(*) AS uses FROM (
         SELECT event_id, name FROM listed WHERE name IN (SELECT name FROM catalog)
         UNION ALL SELECT event_id, name FROM wanted, catalog WHERE s = '')
       JOIN (VALUES ('dev.to', 30), ('dev.to-react', 20), ('dev.to-vue', 20), ('dev.to-javascript', 25)) m(name, max_articles) USING (name)
       GROUP BY 1, 2""",
)
def _resolve(spark, sf_dir):
    kinds = F.array(*[F.lit(s) for s in ("", "dev.to, unknown,dev.to-vue", "dev.to-vue,dev.to-vue", " , x")])
    asked = b.read(spark, sf_dir, "events").select(
        "event_id", F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("sources")
    )
    rows = catalog.resolve_sources(asked, catalog.digest_catalog(spark))
    return rows.groupBy("name", "max_articles").agg(reports.rows().alias("uses"))


@query(
    "trending_sources",
    b.views("repositories", more="""
landed AS (SELECT *, updated_at AS created_at FROM repositories WHERE TRUE),
recent AS (SELECT * FROM landed WHERE created_at > TIMESTAMP '2001-10-05 00:00:00')""")
    + """SELECT 'github_trending' AS source_name, ingest_seq FROM (SELECT * FROM recent WHERE lower(language) = 'typescript' ORDER BY stars DESC, ingest_seq LIMIT 20)
         UNION ALL SELECT 'github_topic_frontend', ingest_seq FROM (SELECT * FROM recent WHERE contains(description, 'css') ORDER BY stars DESC, ingest_seq LIMIT 15)
         UNION ALL SELECT 'github_topic_react', ingest_seq FROM (SELECT * FROM recent WHERE contains(description, 'react') ORDER BY stars DESC, ingest_seq LIMIT 15)""",
)
def _trending_sources(spark, sf_dir):
    topics = F.when(F.contains("description", F.lit("react")), F.array(F.lit("react"))).when(
        F.contains("description", F.lit("css")), F.array(F.lit("frontend"))
    )
    landed = b.repositories(spark, sf_dir).withColumns({"created_at": F.col("updated_at"), "topics": topics})
    plan = catalog.trending_sources(b.REPO_AS_OF, "TypeScript", "monthly")
    return catalog.read_trending(landed, plan).select("source_name", "ingest_seq")
