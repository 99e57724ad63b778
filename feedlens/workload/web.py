"""Page extraction, text cleaning and conversion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions import text as tx
from feedlens.functions.identity import short_id
from feedlens.functions.urls import normalize_url
from feedlens.operators import conform
from feedlens.sources import pages as web
from feedlens.sources import registry
from feedlens.workload import bindings as b
from feedlens.workload import sqltext as q
from feedlens.workload.registry import query


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _first(html: str, patterns: list[str], flags: str = "") -> str:
    cases = " ".join(
        f"WHEN regexp_matches({html}, {_lit(flags + p)}) THEN regexp_extract({html}, {_lit(flags + p)}, 1)" for p in patterns
    )
    return f"CASE {cases} END"


_LIST = " OR ".join(f"regexp_matches(html, {_lit(p)})" for p in vocab.LIST_PAGE_PATTERNS)


@query("is_article_list_page", f"SELECT page_id, {_LIST} AS listing FROM pages")
def _list_page(spark, sf_dir):
    return b.pages(spark, sf_dir).select(
        F.col("payload_seq").alias("page_id"), web.is_article_list_page("body").alias("listing")
    )


_ARTICLE = _lit(vocab.BLOCK_SELECTORS[0])
_BLOCKS = f"""
blocks AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, {_ARTICLE}, 1)) AS block,
         generate_subscripts(regexp_extract_all(html, {_ARTICLE}, 1), 1) - 1 AS i FROM pages
),
read AS (
  SELECT *, {q.page_text("block")} AS content, coalesce({q.page_text(_first("block", vocab.BLOCK_TITLE_SELECTORS))}, '') AS title,
         coalesce(regexp_extract(block, {_lit(vocab.HREF_PATTERN)}, 1), '') AS href FROM blocks
)"""


@query(
    "explode_article_blocks",
    f"""WITH {_BLOCKS.strip()}
        SELECT page_id, i AS position, left(sha256(url || title || i), 16) AS id, title, md5(content) AS digest,
          {q.shorten("content", 200)} AS summary, url, CAST(i AS VARCHAR) AS block_index, 'web' AS tags
        FROM read WHERE title <> '' OR content <> ''""",
)
def _blocks(spark, sf_dir):
    return web.explode_article_blocks(b.pages(spark, sf_dir)).select(
        F.floor(F.col("ingest_seq") / 1000000).alias("page_id"), "position", "id", "title",
        F.md5("content").alias("digest"), "summary", "url",
        conform.get_metadata("metadata", "block_index").alias("block_index"), F.array_join("tags", ",").alias("tags"),
    )


_LINK = _lit(vocab.LINK_PATTERN)
_ENCODED = "replace(replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%2A', '%2A'), '%21', '%21')"
_LINKS = f"""
raw AS (
  SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, {_LINK}, 1)) AS href,
         unnest(regexp_extract_all(html, {_LINK}, 2)) AS inner_html,
         generate_subscripts(regexp_extract_all(html, {_LINK}, 1), 1) AS i FROM pages
),
links AS (
  SELECT page_id, page_url, href, {q.page_text("inner_html")} AS link_text,
         row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position
  FROM raw WHERE {q.page_text("inner_html")} <> ''
)"""


@query("page_links", f"WITH {_LINKS.strip()} SELECT page_id, position, href, link_text FROM links")
def _links(spark, sf_dir):
    return web.page_links(b.pages(spark, sf_dir)).select(
        F.col("payload_seq").alias("page_id"), F.col("position").cast("long").alias("position"), "href", "link_text"
    )


@query(
    "resolved_links",
    f"""WITH {_LINKS.strip()}
        SELECT page_id, position,
          CASE WHEN regexp_matches(href, '^https?:') THEN href
               WHEN regexp_matches(href, '^[A-Za-z0-9$&+,/:;=@._~!''()*-]*$') THEN regexp_extract(page_url, '^https?://[^/]+') || href
               ELSE regexp_extract(page_url, '^https?://[^/]+') || {_ENCODED} END AS url
        FROM links""",
)
def _resolved(spark, sf_dir):
    return web.page_links(b.pages(spark, sf_dir)).select(
        F.col("payload_seq").alias("page_id"), F.col("position").cast("long").alias("position"), "url"
    )


@query(
    "link_articles",
    f"""WITH {_LINKS.strip()} SELECT page_id, position, link_text AS title, 'link,web' AS tags, 'Unknown' AS author
        FROM links""",
)
def _link_articles(spark, sf_dir):
    return web.explode_links(b.pages(spark, sf_dir), limit=None).select(
        F.floor(F.col("ingest_seq") / 1000000).alias("page_id"), "position", "title",
        F.array_join("tags", ",").alias("tags"), "author",
    )


_SINGLE = f"""
one AS (
  SELECT page_id, url, {q.page_text(f"coalesce({_first('html', vocab.CONTENT_SELECTORS, '(?s)')}, html)")} AS content,
    coalesce({q.page_text(_first("html", vocab.TITLE_SELECTORS))}, 'Untitled') AS title,
    coalesce({q.page_text(_first("html", vocab.AUTHOR_SELECTORS))}, 'Unknown') AS author,
    len(regexp_extract_all(html, {_lit("|".join(p.replace("(", "(?:") for p in vocab.TAG_SELECTORS))})) AS tag_hits
  FROM pages
)"""


@query(
    "extract_single_article",
    f"""WITH {_SINGLE.strip()}
        SELECT left(sha256(url), 16) AS id, url, title, md5(content) AS digest, {q.shorten("content", 200)} AS summary, author,
          '2024-01-31 00:00:00' AS published_at, 1 + tag_hits AS tag_count, 'single_article' AS page_type FROM one""",
)
def _single(spark, sf_dir):
    return web.extract_single_article(b.pages(spark, sf_dir)).select(
        "id", "url", "title", F.md5("content").alias("digest"), "summary", "author",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.size("tags").cast("long").alias("tag_count"),
        conform.get_metadata("metadata", "page_type").alias("page_type"),
    )


LANDED_SQL = f"""WITH {_SINGLE.strip()}
        SELECT left(sha256(url), 16) AS id, url, title, md5(content) AS digest, author, '2024-01-31 00:00:00' AS published_at,
          'web,landed' AS first_tags, page_id * 1000000 AS ingest_seq FROM one"""


def landed_articles(spark, sf_dir, stream=False):
    """The pages through the data source for landing folders and the parser of their type."""
    options = dict(url="url", body="html", seq="page_id", tags="web,landed", fetched_at="2024-01-31T00:00:00", metadata='{"source_type": "html"}')
    rows = registry.read_landed(spark, f"{sf_dir}/pages.parquet", stream, **options)
    return rows.select(
        "id", "url", "title", F.md5("content").alias("digest"), "author", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.array_join(F.slice("tags", 1, 2), ",").alias("first_tags"), "ingest_seq",
    )


@query("landed_articles", LANDED_SQL)
def _landed(spark, sf_dir):
    return landed_articles(spark, sf_dir)


@query(
    "page_text",
    f"SELECT page_id, md5({q.page_text('html')}) AS decoded, md5({q.tidy(q.strip('html'))}) AS plain, "
    f"{q.shorten(q.tidy(q.strip('html')), 333)} AS start, left(sha256(url), 16) AS id FROM pages",
)
def _page_text(spark, sf_dir):
    return b.pages(spark, sf_dir).select(
        F.col("payload_seq").alias("page_id"),
        F.md5(tx.page_text("body")).alias("decoded"),
        F.md5(tx.markup_to_text("body")).alias("plain"),
        tx.shorten(tx.markup_to_text("body"), 333).alias("start"),
        short_id("source_url").alias("id"),
    )


# --- conversion -------------------------------------------------------------------------


def unescape_sql(expr: str) -> str:
    """The four entities that the given pages contain."""
    for old, new in [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")]:
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


def headline_sql(t: str) -> str:
    """The part before the earliest separator, if it has five bytes."""
    first = "least(" + ", ".join(f"nullif(strpos({t}, '{sep}'), 0)" for sep in vocab.TITLE_SEPARATORS) + ")"
    head = f"trim(left({t}, {first} - 1))"
    return f"CASE WHEN {first} IS NOT NULL AND strlen({head}) >= 5 THEN {head} ELSE {t} END"


def _scripts_sql(expr: str, flags: str) -> str:
    out = f"regexp_replace({expr}, '{flags}<script[^>]*>.*?</script>', '', 'g')"
    return f"regexp_replace({out}, '{flags}<style[^>]*>.*?</style>', '', 'g')"


def content_sql(expr: str, flags: str = "", limit: int = 50000) -> str:
    tidied = f"regexp_replace({unescape_sql(q.strip(_scripts_sql(expr, flags)))}, '[\\t\\n\\f\\r ]+', ' ', 'g')"
    return f"trim({q.shorten(tidied, limit)})"


@query(
    "tidy_content",
    f"""SELECT page_id, md5({content_sql("html")}) AS parity, md5({content_sql("html", "(?is)")}) AS dotall,
        {content_sql("html", "", 120)} AS start FROM pages""",
)
def _tidy(spark, sf_dir):
    return b.pages(spark, sf_dir).select(
        F.col("payload_seq").alias("page_id"),
        F.md5(tx.tidy_content("body")).alias("parity"),
        F.md5(tx.tidy_content("body", dotall=True)).alias("dotall"),
        tx.tidy_content("body", 120).alias("start"),
    )


_HEADLINE = "regexp_extract(html, '<title[^>]*>(.*?)</title>', 1)"


@query(
    "tidy_title",
    f"""WITH t AS (SELECT page_id, {_HEADLINE} AS title FROM pages)
        SELECT page_id, {q.tidy(q.strip(_scripts_sql(unescape_sql("title"), "")))} AS title,
          {q.tidy(unescape_sql("title"))} AS plain FROM t""",
)
def _title(spark, sf_dir):
    title = F.regexp_extract("body", r"(?d)<title[^>]*>(.*?)</title>", 1)
    rows = b.pages(spark, sf_dir).select(F.col("payload_seq").alias("page_id"), title.alias("title"))
    return rows.select("page_id", tx.tidy_title("title").alias("title"), tx.tidy_text("title").alias("plain"))


_CHROME = "html"
for _p in vocab.PAGE_CHROME:
    _CHROME = f"regexp_replace({_CHROME}, {_lit('(?is)' + _p)}, '', 'g')"


@query(
    "drop_page_chrome",
    f"""WITH t AS (SELECT page_id, {_CHROME} AS rest, {_HEADLINE} || CASE page_id % 3 WHEN 0 THEN ' | Site' WHEN 1 THEN ' - A :: B' ELSE '' END AS title FROM pages)
        SELECT page_id, md5(rest) AS digest, {headline_sql("title")} AS headline FROM t""",
)
def _chrome(spark, sf_dir):
    page = F.col("payload_seq")
    suffix = F.when(page % 3 == 0, " | Site").when(page % 3 == 1, " - A :: B").otherwise("")
    title = F.concat(F.regexp_extract("body", r"(?d)<title[^>]*>(.*?)</title>", 1), suffix)
    return b.pages(spark, sf_dir).select(
        page.alias("page_id"),
        F.md5(conform.drop_page_chrome("body")).alias("digest"),
        conform.page_headline(title).alias("headline"),
    )


_TRACK = ", ".join(f"'{p}'" for p in vocab.TRACKING_PARAMS)


@query(
    "normalize_url",
    f"""WITH p AS (
          SELECT page_id, CASE WHEN page_id % 2 = 0 THEN upper(regexp_extract(url, '^(https?://[^/?#]*)', 1)) ELSE regexp_extract(url, '^(https?://[^/?#]*)', 1) END AS origin,
                 regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
                 regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS frag FROM pages),
        c AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({_TRACK}))), '&') AS kept FROM p)
        SELECT page_id, lower(origin) || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END || CASE WHEN frag <> '' THEN '#' || frag ELSE '' END AS url,
          regexp_replace(regexp_extract(lower(origin), '^https?://(.*)$', 1), '^www\\.', '') AS source FROM c""",
)
def _normalize_url(spark, sf_dir):
    origin = F.regexp_extract("source_url", "^(https?://[^/?#]*)", 1)
    rest = F.substring("source_url", F.char_length(origin) + 1, F.char_length("source_url"))
    page = F.col("payload_seq")
    url = F.when(page % 2 == 0, F.concat(F.upper(origin), rest)).otherwise(F.col("source_url"))
    # a source counts as a URL only with a lower-case scheme
    return b.pages(spark, sf_dir).select(
        page.alias("page_id"), normalize_url(url).alias("url"), conform.normalize_source("source_url").alias("source")
    )


@query(
    "normalize_tags",
    b.views("articles")
    + """SELECT id, array_to_string(list_filter([language, 'news', CASE WHEN ingest_seq % 2 = 0 THEN 'a & b' END], lambda x: x IS NOT NULL), ',') AS tags,
         CASE WHEN source_type = 'html' THEN 'api' ELSE source_type END AS kind,
         list_contains(tags, 'curated') AS curated FROM articles""",
)
def _normalize_tags(spark, sf_dir):
    messy = F.array(
        F.concat(F.lit(" "), F.upper("language")), F.lit("News\n"), F.lit("news"), F.lit(""), F.repeat(F.lit("x"), 51),
        F.when(F.col("ingest_seq") % 2 == 0, "a &amp; b").otherwise(F.col("language")),
    )
    kind = F.when(F.col("source_type") == "html", "Web").otherwise(F.upper("source_type"))
    return b.articles(spark, sf_dir).select(
        "id", F.array_join(conform.normalize_tags(messy), ",").alias("tags"),
        conform.normalize_source_type(kind).alias("kind"), conform.has_tag("tags", "curated").alias("curated"),
    )


_FIRST = """
parts AS (
  SELECT id, list_filter(list_transform(string_split_regex(body, '[.!?]'), lambda s: trim(s)), lambda s: s <> '') AS s, body, given FROM c
),
grown AS (
  SELECT *, list_reduce(list_transform(s, lambda x: {'out': x, 'full': false}),
    lambda acc, x: CASE WHEN acc.full OR strlen(acc.out) + strlen(x.out) + 2 > LIMIT_N THEN {'out': acc.out, 'full': true}
      WHEN acc.out = '' THEN {'out': x.out, 'full': false} ELSE {'out': acc.out || '. ' || x.out, 'full': false} END,
    {'out': '', 'full': false}).out AS picked FROM parts
)"""


def _summary_sql(limit: int) -> str:
    return (
        b.views("articles", more=f"c AS (SELECT id, {q.tidy('content')} AS body, {q.tidy('summary')} AS given FROM articles),"
                + _FIRST.replace("LIMIT_N", str(limit)))
        + f"""SELECT id, CASE WHEN strlen(given) BETWEEN 10 AND {limit} THEN given WHEN picked = '' THEN {q.shorten("body", limit)}
              ELSE picked || '.' END AS summary FROM grown"""
    )


@query("derive_summary", _summary_sql(300))
def _derive(spark, sf_dir):
    return b.articles(spark, sf_dir).select("id", conform.derive_summary("summary", "content", 300).alias("summary"))


@query(
    "prepare_by_source_type",
    b.views("articles", more=f"t AS (SELECT *, {q.tidy('content')} AS body FROM articles)")
    + f"""SELECT id, CASE source_type WHEN 'rss' THEN title WHEN 'api' THEN '"' || title || '\\' ELSE {headline_sql("(title || ' | Site')")} END AS title,
           CASE source_type WHEN 'api' THEN 'true' ELSE '' END AS api_processed,
           CASE WHEN source_type = 'html' AND ingest_seq % 2 = 1 THEN 'true' ELSE '' END AS date_fallback FROM t""",
)
def _prepare(spark, sf_dir):
    seq, kind = F.col("ingest_seq"), F.col("source_type")
    raw = b.articles(spark, sf_dir).withColumns(
        {
            "title": F.when(kind == "rss", F.concat(F.lit("RSS: [RSS] [x y] "), "title"))
            .when(kind == "api", F.concat(F.lit('\\"'), "title", F.lit("\\\\")))
            .otherwise(F.concat("title", F.lit(" | Site"))),
            "published_at": F.when(seq % 2 == 0, F.col("published_at")),
        }
    )
    done = conform.prepare_by_source_type(raw, b.AS_OF)

    def flag(key):
        return F.coalesce(conform.get_metadata("metadata", key), F.lit("")).alias(key)

    return done.select("id", "title", flag("api_processed"), flag("date_fallback"))


@query(
    "convert_articles",
    b.views("articles", more=f"c AS (SELECT * REPLACE ({q.tidy('content')} AS content, CASE WHEN source_type = 'html' THEN {q.tidy(headline_sql('title'))} ELSE {q.tidy('title')} END AS title), {q.tidy('content')} AS body, {q.tidy('summary')} AS given FROM articles),"
            + _FIRST.replace("LIMIT_N", "1000") + f""",
made AS (
  SELECT c.* REPLACE (CASE WHEN strlen(g.given) BETWEEN 10 AND 1000 THEN g.given WHEN picked = '' THEN {q.shorten("g.body", 1000)} ELSE picked || '.' END AS summary)
  FROM c JOIN grown g USING (id)
),
s AS (SELECT * REPLACE (CASE WHEN strlen(summary) > 1000 THEN {q.shorten("summary", 500)} ELSE summary END AS summary) FROM made)""")
    + f"""SELECT md5(url || '|' || title) AS id, title, url, source_type, md5(content) AS digest, array_to_string(tags, ',') AS tags,
            author, round({b.QUALITY_SQL}, 6) AS quality, CASE WHEN source_type = 'rss' AND ingest_seq % 4 = 0 THEN '' ELSE md5(summary) END AS summary_digest,
            '' AS error FROM s WHERE strlen(title) > 20""",
)
def _convert(spark, sf_dir):
    done = conform.convert_articles(b.articles(spark, sf_dir), b.AS_OF, conform.ConvertOptions(max_content=None))
    # feeds without a summary take their first paragraph, which "first_paragraph" checks
    rss = (F.col("source_type") == "rss") & (F.col("ingest_seq") % 4 == 0)
    return done.where(F.octet_length("title") > 20).select(
        "id", "title", "url", "source_type", F.md5("content").alias("digest"), F.array_join("tags", ",").alias("tags"),
        conform.get_metadata("metadata", "author").alias("author"), F.round("quality", 6).alias("quality"),
        F.when(rss, "").otherwise(F.md5("summary")).alias("summary_digest"), F.coalesce("error", F.lit("")).alias("error"),
    )


_EDGES = r"regexp_replace(x, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')"


@query(
    "first_paragraph",
    b.views("articles", more=f"""
parts AS (SELECT id, content, list_transform(string_split(content, chr(10) || chr(10)), lambda x: {_EDGES}) AS raw FROM articles),
clean AS (SELECT *, list_transform(raw, lambda x: {q.page_text("x")}) AS done FROM parts),
best AS (
  SELECT id, content, done[1] AS head, list_filter(list_zip(raw, done), lambda e: strlen(e[1]) > 50 AND strlen(e[2]) > 30 AND strlen(e[2]) <= 500)[1][2] AS good
  FROM clean)""")
    + f"""SELECT id, coalesce(good, CASE WHEN head <> '' THEN {q.shorten("head", 200)} END, {q.shorten("content", 200)}) AS paragraph FROM best""",
)
def _paragraph(spark, sf_dir):
    return b.articles(spark, sf_dir).select("id", tx.first_paragraph("content").alias("paragraph"))


@query(
    "convert_repositories",
    b.views("repositories", more=f"""
made AS (SELECT * REPLACE (CASE WHEN ingest_seq % 9 = 0 THEN '' ELSE name END AS name), CASE WHEN ingest_seq % 5 = 0 THEN -3 ELSE stars END AS given FROM repositories),
s AS (SELECT * REPLACE (CASE WHEN given < 0 THEN 0 ELSE given END AS stars) FROM made)""")
    + f"""SELECT ingest_seq, name, description, language, stars, forks, round({b.TREND_SQL}, 6) AS trend_score,
          CASE WHEN name = '' THEN 'repository name is required' ELSE '' END AS error FROM s""",
)
def _convert_repos(spark, sf_dir):
    seq = F.col("ingest_seq")
    repos = b.repositories(spark, sf_dir)
    stars = F.when(seq % 5 == 0, "-3").otherwise(F.col("stars").cast("string"))
    given = repos.withColumns(
        {
            "name": F.when(seq % 9 == 0, "").otherwise(F.col("name")),
            "metadata": F.create_map(
                F.lit("description"), "description", F.lit("language"), "language", F.lit("stars"), stars,
                F.lit("forks"), F.col("forks").cast("string"),
                F.lit("updated_at"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"),
            ),
        }
    ).select("name", "full_name", "url", "metadata", "ingest_seq")
    return conform.convert_repositories(given, b.REPO_AS_OF).select(
        "ingest_seq", "name", "description", "language", "stars", "forks",
        F.round("trend_score", 6).alias("trend_score"), F.coalesce("error", F.lit("")).alias("error"),
    )


@query(
    "require_fields",
    b.views("articles")
    + """SELECT CASE WHEN ingest_seq % 4 = 0 THEN 'title is required' WHEN ingest_seq % 4 = 1 THEN 'URL is required'
         WHEN ingest_seq % 4 = 2 THEN 'source is required' ELSE '' END AS error, count(*) AS rows FROM articles GROUP BY 1""",
)
def _require(spark, sf_dir):
    seq = F.col("ingest_seq")
    broken = b.articles(spark, sf_dir).withColumns(
        {
            "title": F.when(seq % 4 == 0, " \t").otherwise(F.concat(F.lit("t"), "title")),
            "url": F.when(seq % 4 == 1, "").otherwise(F.col("url")),
            "source": F.when(seq % 4 == 2, " ").otherwise(F.col("source")),
        }
    )
    return conform.error_summary(broken.withColumn("error", conform.require_fields()))
