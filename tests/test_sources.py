from __future__ import annotations

import random
import re
from urllib.parse import urljoin, urlsplit

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedlens.functions.urls import resolve_url
from feedlens.schemas import PAYLOAD
from feedlens.sources import api, catalog, feeds, pages, registry

AT = datetime(2024, 1, 31)


def payload(spark, url, body, tags=("cfg",), metadata=None):
    return spark.createDataFrame([(url, body, list(tags), "en", metadata or {}, AT, 1)], PAYLOAD)


RSS = """<?xml version="1.0"?>
<rss version="2.0"><channel><title>F</title>
<item><title> A &amp;amp; B </title><description>&lt;p&gt;One  two&lt;/p&gt;</description><link>http://e.com/1</link>
<guid>g1</guid><pubDate>Mon, 01 Jan 2024 12:00:00 GMT</pubDate><author>Ann</author><category>Tech</category></item>
<item><title>Second</title><link>http://e.com/2</link></item>
</channel></rss>"""

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title>
<entry><id>e1</id><title>T</title><link href="http://e.com/self" rel="self"/><link href="http://e.com/1"/>
<published>2024-01-01T12:00:00Z</published><author><name>Bo</name></author>
<content type="html">first</content><summary>sum</summary><category term="tech"/></entry></feed>"""


def test_rss(spark):
    rows = feeds.parse_rss(payload(spark, "http://e.com/rss", RSS)).orderBy("position").collect()
    first, second = rows
    assert (first.id, first.title, first.content, first.author) == ("g1", "A & B", "One two", "Ann")
    assert first.tags == ["Tech", "cfg"] and str(first.published_at) == "2024-01-01 12:00:00"
    assert second.tags == ["cfg"] and len(second.id) == 16 and second.published_at is None
    assert second.ingest_seq == 1_000_001


def test_atom_and_mixed(spark):
    row = feeds.parse_feed(payload(spark, "http://e.com/atom", ATOM)).collect()[0]
    assert (row.id, row.url, row.author, row.content, row.summary) == ("e1", "http://e.com/1", "Bo", "first", "sum")
    assert row.tags == ["tech", "cfg"]
    bad = feeds.unreadable_feeds(payload(spark, "u", "<html/>").union(payload(spark, "v", RSS))).collect()
    assert [r.source_url for r in bad] == ["u"]


def test_api_payloads(spark):
    repos = '{"items":[{"id":7,"full_name":"a/b","stargazers_count":5,"fork":true,"topics":["x"],"owner":{"login":"a"},"created_at":"2024-01-01T00:00:00Z"}]}'
    row = api.parse_api(payload(spark, "https://api.github.com/search/repositories?q=x", repos, metadata={"stars": "9"})).collect()[0]
    assert (row.id, row.title, row.author, row.tags) == ("7", "a/b", "a", ["x", "cfg"])
    # settings of the source win over parsed values
    assert row.metadata["stars"] == "9" and row.metadata["is_fork"] == "true"
    issue = '[{"id":1,"number":3,"title":"Bug","body":"text","state":"open","labels":[{"name":"l"}],"user":{"login":"u"}}]'
    row = api.parse_api(payload(spark, "https://api.github.com/repos/a/b/issues", issue)).collect()[0]
    assert (row.title, row.tags) == ("#3: Bug", ["github-issue", "open", "l", "cfg"])
    posts = '[{"id":1,"title":"P","user":{"username":"un","name":""},"tag_list":["js"]},{"id":2,"organization":{"name":"Org"}}]'
    rows = api.parse_api(payload(spark, "https://dev.to/api/articles", posts)).orderBy("position").collect()
    assert [r.author for r in rows] == ["un", "Org"]
    row = api.parse_api(payload(spark, "https://x.com/api/v1", "äb")).collect()[0]
    assert row.summary == "API response containing 3 bytes of data" and row.tags == ["api", "cfg"]


LIST = '<article><h2>One</h2><a href="/1">x</a> text</article><article><h2>Two</h2>more</article>'
SINGLE = """<html><head><title>My Title</title><meta name="author" content="Jo">
<meta property="article:published_time" content="2024-01-05T10:00:00Z"><meta name="keywords" content="a, b"></head>
<body><main>Main
text</main></body></html>"""


def test_pages(spark):
    assert [r[0] for r in payload(spark, "u", LIST).select(pages.is_article_list_page("body")).collect()] == [True]
    blocks = pages.parse_pages(payload(spark, "https://e.com/blog", LIST)).orderBy("position").collect()
    assert [(b.title, b.url) for b in blocks] == [("One", "https://e.com/1"), ("Two", "https://e.com/blog")]
    assert blocks[1].metadata["block_index"] == "1"
    one = pages.parse_pages(payload(spark, "https://e.com/x", SINGLE)).collect()[0]
    assert (one.title, one.content, one.author) == ("My Title", "Main text", "Jo")
    assert one.tags == ["cfg", "a", "b"] and str(one.published_at) == "2024-01-05 10:00:00"
    assert one.metadata["page_type"] == "single_article"


def test_list_page_without_blocks_falls_back_to_links(spark):
    html = '<h3>a</h3><h3>b</h3><a href="x">X</a><a href="y"></a><a href="z">Z</a>'
    rows = pages.parse_pages(payload(spark, "https://e.com/d/p", html)).orderBy("position").collect()
    assert [(r.title, r.url, r.position) for r in rows] == [("X", "https://e.com/d/x", 0), ("Z", "https://e.com/d/z", 1)]
    many = "<h3>a</h3><h3>b</h3>" + "".join(f'<a href="/{i}">t{i}</a>' for i in range(60))
    assert pages.parse_pages(payload(spark, "https://e.com/", many)).count() == 50


@pytest.mark.parametrize(
    ("href", "expected"),
    [("https://other.com/page", "https://other.com/page"), ("/article/123", "https://example.com/article/123"),
     ("article/123", "https://example.com/article/123"), ("#s", "https://example.com/blog#s"),
     ("//cdn.com/x", "https://cdn.com/x"), ("?q=1", "https://example.com/blog?q=1"),
     ("../up/./x", "https://example.com/up/x"), ("", "https://example.com/blog")],
)
def test_resolve_url(spark, href, expected):
    df = spark.createDataFrame([(href, "https://example.com/blog")], "r string, b string")
    assert df.select(resolve_url("r", "b")).collect()[0][0] == expected


def test_catalog(spark):
    rows = catalog.digest_catalog(spark)
    asked = spark.createDataFrame([(1, "dev.to-vue, nope,dev.to"), (2, "")], "id int, sources string")
    got = catalog.resolve_sources(asked, rows).orderBy("id", "position").collect()
    assert [r["name"] for r in got if r.id == 1] == ["dev.to-vue", "dev.to"]
    assert len([r for r in got if r.id == 2]) == 4
    assert [s.name for s in catalog.trending_sources(AT)] == [
        "github_trending", "github_topic_frontend", "github_topic_react", "github_topic_vue",
    ]
    assert [s.name for s in catalog.trending_sources(AT, category="typescript")] == ["github_trending", "github_topic_typescript"]
    assert set(catalog.search_sources("vue", platform="github")) == {"github_repos"}
    errors = spark.createDataFrame([("a", "HTTP error 404"), ("a", "odd"), ("b", None)], "source string, error string")
    assert [tuple(r) for r in catalog.classify_fetch_errors(errors).collect()] == [("a", 2, 1, 1)]


def test_registry(spark):
    assert registry.source_types() == ["api", "html", "rss"]
    with pytest.raises(KeyError):
        registry.parser_for("gopher")
    registry.register_source("gopher", lambda df: pages.extract_single_article(df))
    try:
        rows = registry.parse_payloads(payload(spark, "gopher://x", SINGLE, metadata={"source_type": "gopher"}))
        assert rows.count() == 1
    finally:
        registry._PARSERS.pop("gopher")
    assert registry.unknown_sources(payload(spark, "u", "b", metadata={"source_type": "ftp"})).count() == 1


def test_cap(spark):
    rows = feeds.parse_rss(payload(spark, "http://e.com/rss", RSS))
    assert catalog.cap_per_source(rows, 1).count() == 1
    assert catalog.cap_per_source(rows, F.lit(0)).count() == 2


def test_dotted_links_equal_the_standard_library(spark):
    draw = random.Random(3)
    part = lambda: draw.choice(["..", ".", "a", "b", "", "..."])
    pairs = []
    for _ in range(400):
        base = draw.choice(["http://e.com", "https://E.com:8080", "ftp://h"]) + draw.choice(["", "/", "/" + "/".join(part() for _ in range(4))])
        path = draw.choice(["", "/"]) + "/".join(part() for _ in range(draw.randrange(1, 6)))
        link = draw.choice(["", "", "", "http:", "mailto:", "//other"]) + path + draw.choice(["", "?q=1", "#f", "?", "?a#b"])
        if re.search(r"(^|[:/])\.\.?(/|$|[?#])", link):
            pairs.append((base, link))
    df = spark.createDataFrame(pairs, "b string, r string")
    got = [r[0] for r in df.select(resolve_url("r", "b")).collect()]
    want = [urljoin(b, r) for b, r in pairs]
    dotted = [bool(re.search(r"(^|/)\.\.?(/|$)", urlsplit(r).path)) and "//other" not in r for _, r in pairs]
    assert [(p, g) for p, g, d in zip(pairs, got, dotted) if d] == [(p, w) for p, w, d in zip(pairs, want, dotted) if d]
    assert sum(dotted) > 150
    assert "ArrowEvalPython" not in df.select(resolve_url("r", "b"))._jdf.queryExecution().toString()
