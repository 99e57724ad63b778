from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedlens.operators import conform, corpus, filters, ordering, personalize, summarize
from feedlens.operators.dedup import dedup_by_url, keep_first, require_some, union_sources
from feedlens.operators.filters import ArticleFilter
from feedlens.plans.topic import topic_search
from feedlens.plans.trending import trending_repos
from feedlens.plans.weekly import weekly_news
from feedlens.schemas import ARTICLE, RAW_ARTICLE, REPOSITORY

NOW = datetime(2024, 6, 1, 12)


def raw(spark, rows):
    base = dict(id="i", title="t", content="", summary="", author="", url="http://e.com/1", published_at=NOW, tags=[],
                source="s", source_type="api", language="", metadata={}, ingest_seq=0)
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in RAW_ARTICLE) for r in rows], RAW_ARTICLE)


def articles(spark, rows):
    base = dict(id="i", title="t", url="u", source="s", source_type="api", published_at=NOW, summary="", content="",
                tags=[], relevance=0.5, quality=0.5, metadata={}, ingest_seq=0)
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in ARTICLE) for r in rows], ARTICLE)


def repos(spark, rows):
    base = dict(id="i", name="n", full_name="o/n", description="", url="u", language="", stars=0, forks=0,
                trend_score=0.0, updated_at=NOW, metadata={}, ingest_seq=0)
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in REPOSITORY) for r in rows], REPOSITORY)


def test_filter_counts(spark):
    rows = raw(spark, [
        dict(id="1", title="Go Programming", content="This is a comprehensive guide to Go programming language", author="John Doe", tags=["go"], published_at=datetime(2024, 1, 1)),
        dict(id="2", title="Python Basics", content="Learn Python programming", author="Jane Smith", tags=["python"], published_at=datetime(2024, 1, 2)),
        dict(id="3", title="JavaScript Tips", content="Short tips for JavaScript", author="Bob", tags=["tips"], published_at=datetime(2024, 1, 3)),
    ])
    rules = [ArticleFilter(keywords=["Go", "programming"]), ArticleFilter(authors=["John Doe"]), ArticleFilter(tags=["python"]),
             ArticleFilter(date_from="2024-01-02"), ArticleFilter(min_length=30), ArticleFilter()]
    assert [filters.filter_articles(rows, r).count() for r in rules] == [2, 1, 1, 2, 1, 3]


def test_period():
    p = filters.resolve_period(NOW)
    assert p.days == 7 and p.end == NOW
    with pytest.raises(ValueError):
        filters.resolve_period(NOW, "2024-06-02", "2024-06-01")
    with pytest.raises(ValueError):
        filters.resolve_period(NOW, "2024-01-01", "2024-06-01")


def test_conversion_steps(spark):
    rows = raw(spark, [
        dict(ingest_seq=1, title="[RSS] Tech News: New Framework Released", source_type="rss", summary="Existing RSS summary", author="A &amp; B", language=" EN ", metadata={"author": "kept"}),
        dict(ingest_seq=2, title='API with \\"quotes\\"', source_type="api", summary="API summary for testing", tags=[" React ", "react", "x" * 60]),
        dict(ingest_seq=3, title="Great Article Title | Website", content="<nav>Menu</nav><div>Main content</div>", source_type="html", summary="HTML summary for &amp;amp; testing", published_at=None),
        dict(ingest_seq=4, title=" "),
        dict(ingest_seq=5, title="No text at all"),
    ])
    got = {r.ingest_seq: r for r in conform.convert_articles(rows, NOW).collect()}
    assert got[1].title == "Tech News: New Framework Released" and got[1].metadata["author"] == "kept" and got[1].metadata["language"] == "en"
    assert got[2].title == 'API with "quotes"' and got[2].metadata["api_processed"] == "true" and got[2].tags == ["react"]
    assert got[3].title == "Great Article Title" and got[3].content == "Main content" and got[3].metadata["date_fallback"] == "true"
    assert got[3].published_at == NOW and got[3].summary == "HTML summary for & testing"
    assert got[4].error == "invalid collector article: title is required"
    assert got[5].error.startswith("failed to set summary")
    assert [got[i].error for i in (1, 2, 3)] == [None] * 3


def test_repositories(spark):
    df = spark.createDataFrame(
        [("n", "o/n", "http://E.com", {"stars": "12", "forks": "-1", "description": "d" * 1200, "language": "x" * 51, "updated_at": "2024-05-31"}, 1),
         ("", "o/n", "u", {}, 2)],
        "name string, full_name string, url string, metadata map<string,string>, ingest_seq long",
    )
    one, two = conform.convert_repositories(df, NOW).orderBy("ingest_seq").collect()
    # a description without spaces keeps 1003 bytes after the cut and is refused, as is a long language
    assert (one.stars, one.forks, one.description, one.language, one.error) == (12, 0, "", "", None)
    assert one.trend_score == pytest.approx(0.5) and two.error == "repository name is required"


def test_first_wins_and_union(spark):
    rows = articles(spark, [dict(id="b", url="x", ingest_seq=2), dict(id="a", url="x", ingest_seq=1), dict(id="c", url="", ingest_seq=3)])
    once = dedup_by_url(rows)
    assert sorted(r.id for r in once.collect()) == ["a", "c"]
    assert sorted(map(str, dedup_by_url(once).collect())) == sorted(map(str, once.collect()))
    assert keep_first(rows, F.lit(1)).collect()[0].id == "a"
    good, bad = union_sources({"p": rows, "q": rows.withColumn("error", F.lit("boom"))})
    assert good.count() == 3 and bad.first().error == "source q: boom"
    with pytest.raises(RuntimeError):
        require_some(good.where("false"), bad)


SORTED = [
    dict(id="1", relevance=0.9, quality=0.8, published_at=NOW - timedelta(hours=24)),
    dict(id="2", relevance=0.7, quality=0.9, published_at=NOW - timedelta(hours=2)),
    dict(id="3", relevance=0.5, quality=0.95, published_at=NOW - timedelta(hours=72)),
    dict(id="4", relevance=0.5 + 1e-12, quality=0.6, published_at=NOW - timedelta(hours=168)),
]


@pytest.mark.parametrize(
    ("config", "expected"),
    [(("relevance", "time", "desc"), "1234"), (("time", "relevance", "desc"), "2134"), (("popularity", "time", "asc"), "4123"),
     (("composite", "time", "desc"), "1234")],
)
def test_sorter(spark, config, expected):
    order = ordering.order_articles_by(ordering.SortConfig(*config), NOW)
    ids = "".join(r.id for r in ordering.top(articles(spark, SORTED), order, None).collect())
    if config[0] == "composite":
        assert ids[-1] == "4" and set(ids) == set("1234")
    else:
        assert ids == expected


def test_pages_cover_everything(spark):
    rows = articles(spark, [dict(id=f"{i:02d}") for i in range(23)])
    order = [F.col("id").asc()]
    seen = [r.id for p in (1, 2, 3) for r in ordering.paginate(rows, order, p, 10).rows.collect()]
    assert seen == [f"{i:02d}" for i in range(23)]
    info = ordering.paginate(rows, order, 4, 10).info.first()
    assert (info.total_pages, info.has_next, info.has_prev) == (3, False, True)
    assert ordering.paginate(rows, order, 4, 10).rows.count() == 0
    assert ordering.paginate(rows, order, 0, 0).info.first().page_size == 20
    with pytest.raises(ValueError):
        ordering.validate_page(1, 101)
    with pytest.raises(ValueError):
        ordering.validate_sort_config(ordering.SortConfig(order="up"))


CORPUS = [
    dict(id="go", title="Go Programming Guide", summary="Learn golang", content="Go is a compiled language for servers", tags=["go", "programming"]),
    dict(id="js", title="JavaScript Frameworks", summary="React and Vue", content="JavaScript runs in browsers", tags=["javascript", "react"]),
    dict(id="py", title="Python Machine Learning", summary="Learn python", content="Python for data science", tags=["python"]),
    dict(id="db", title="Database Design", summary="SQL tables", content="Relational database normalization", tags=["sql", "database"]),
]


def test_relevance_ranks_the_right_article_first(spark):
    rows = articles(spark, CORPUS)
    for words, best in ((["programming", "go"], "go"), (["javascript", "react"], "js"), (["database", "sql"], "db")):
        ranked = corpus.relevance_score(rows, words, rows).orderBy(F.desc("relevance")).collect()
        assert ranked[0].id == best and all(0 <= r.relevance <= 1 for r in ranked)
    assert corpus.relevance_score(rows, [], rows).first().relevance == 0.0
    empty = rows.where("false")
    half = corpus.tfidf_score(rows, ["go"], empty).orderBy("id").collect()
    match = corpus.keyword_match(rows, ["go"]).orderBy("id").collect()
    assert [h.tfidf for h in half] == pytest.approx([m.keyword_score / 2 for m in match])


def test_keywords_and_summaries(spark):
    text = ("Artificial intelligence machine learning algorithms are transforming technology industry. "
            "Machine learning and artificial intelligence research continues to advance rapidly. Short. "
            "Nobody knows what tomorrow brings to this small town by the river at all.")  # fmt: skip
    rows = articles(spark, [dict(id="a", content=text), dict(id="b", content="Tiny."), dict(id="c", content=""), dict(id="d", content="x" * 60)])
    found = {r.keyword for r in summarize.extract_keywords(rows).where("id = 'a'").collect()}
    assert {"artificial", "intelligence", "machine", "learning"} <= found and not {"are", "and", "to", "the"} & found
    got = {r.id: r for r in summarize.summarize(rows).collect()}
    assert got["b"].generated_summary == "Tiny." and got["c"].summary_error == "text cannot be empty"
    assert got["a"].generated_summary.startswith("Artificial intelligence") and len(got["a"].generated_summary) <= 150
    assert got["d"].generated_summary == "x" * 60
    rated = summarize.process_article(rows, NOW).orderBy("id").collect()
    assert rated[1].error == "setting summary failed: summary too short (minimum 10 characters)"
    assert rated[0].error is None and 0 < rated[0].quality <= 1
    tagged = {r.id: r.tags for r in summarize.fill_tags(rows).collect()}
    assert tagged["a"] == ["artificial", "intelligence", "learning", "machine", "advance"] and tagged["c"] == []


def test_personalisation_takes_the_first_topic(spark):
    rows = articles(spark, [dict(title="Vue and React", relevance=0.5, source="dev.to")])
    prefs = personalize.Preferences(["react", "vue"], ["dev.to"], {"react": 0.3}, recency=1.0)
    row = personalize.personalize_articles(rows, prefs, NOW).first()
    assert row.relevance == pytest.approx(0.8) and row.quality == pytest.approx(0.7)
    plain = personalize.personalize_articles(rows, personalize.Preferences(["nothing"]), NOW).first()
    assert (plain.relevance, plain.quality) == (0.5, 0.5)


def test_queries(spark):
    rows = articles(spark, [
        dict(id="1", title="React hooks", summary="A long enough summary about hooks in react apps today", url="a", quality=0.9, tags=["react"], ingest_seq=1),
        dict(id="2", title="react HOOKS", url="a", quality=0.9, ingest_seq=2),
        dict(id="3", title="Old", url="c", quality=0.9, published_at=NOW - timedelta(days=40), ingest_seq=3),
        dict(id="4", title="Poor", url="d", quality=0.1, ingest_seq=4),
    ])
    result = weekly_news(rows, NOW)
    assert [r.id for r in result.rows["articles"].collect()] == ["1"]
    totals = result.reports["totals"].first()
    assert (totals.total_count, totals.filter_count, totals.days) == (3, 1, 7)
    assert weekly_news(rows, NOW, category="zzz").reports["summary"].first()[0].startswith("在 2024-05-25 到 2024-06-01 期间未找到")
    with pytest.raises(ValueError):
        weekly_news(rows, NOW, max_results=201)
    code = repos(spark, [
        dict(id="a", full_name="O/A", stars=50, language="Go", metadata={"is_fork": "t"}, ingest_seq=1),
        dict(id="b", full_name="o/b", stars=2000, forks=200, description="react ui", language="TypeScript", ingest_seq=2),
        dict(id="c", full_name="O/B", stars=9, ingest_seq=3),
    ])
    assert [r.id for r in trending_repos(code, NOW).rows["repositories"].collect()] == ["b"]
    assert [r.id for r in trending_repos(code, NOW, include_forks=True).rows["repositories"].collect()] == ["b", "a"]
    talks = spark.createDataFrame([("t", "react question", "why", "reddit", 3, 1, NOW, 1)],
                                  "id string, title string, content string, platform string, score long, replies long, created_at timestamp_ntz, ingest_seq long")
    found = topic_search(rows, code, talks, "react hooks", NOW)
    assert found.rows["articles"].first().id in ("1", "2") and found.rows["discussions"].first().id == "t"
    assert found.reports["summary"].first().total_results == sum(df.count() for df in found.rows.values())
    assert topic_search(rows, code, talks, "react", NOW, max_results=1).rows["articles"].count() == 0
    with pytest.raises(ValueError):
        topic_search(rows, code, talks, " ", NOW)


def test_keep_first_gives_one_row_per_key(spark):
    """Exact repeats, shared orders, null orders and null keys."""
    rows = [("a", 1, "x", {"m": "1"})] * 3 + [("b", 2, "y", None), ("b", 2, "z", {}), ("b", 2, "z", {}), ("b", 9, "w", {})]
    rows += [("c", None, "x", {}), ("c", None, "y", {}), ("d", None, "no", {}), ("d", 5, "yes", {}), (None, 1, "n", {}), (None, 1, "n", {})]
    df = spark.createDataFrame(rows, "k string, ingest_seq int, v string, m map<string,string>").repartition(3)
    got = {r.k: r for r in keep_first(df, "k").collect()}
    assert keep_first(df, "k").count() == len(got) == 5 and keep_first(df, "k").columns == df.columns
    assert got["d"].v == "yes" and got["a"].m == {"m": "1"} and got["b"].v in "yz" and got[None].v == "n"
    assert got == {r.k: r for r in keep_first(df.repartition(5), "k").collect()}  # the same row each time


def test_repeated_rows_reach_no_result(spark):
    twice = articles(spark, [dict(id="a", url="u1", title="react hooks", ingest_seq=1)] * 2 + [dict(id="b", url="u2", title="react", ingest_seq=1)])
    assert weekly_news(twice, as_of=NOW).rows["articles"].count() == 2
    twin = repos(spark, [dict(id="r", full_name="o/n", stars=50, ingest_seq=1)] * 3)
    assert trending_repos(twin, as_of=NOW, min_stars=1).rows["repositories"].count() == 1


def test_page_index(spark, tmp_path):
    rows = articles(spark, [dict(id=f"{i:03}", quality=i % 7 / 10, content="x") for i in range(95)])
    order = [F.col("quality").desc(), F.col("id").asc()]
    index = ordering.PageIndex.build(rows, order, str(tmp_path / "index"), block_rows=10)
    for page, size in [(1, 20), (2, 7), (5, 20), (6, 20), (0, 0)]:
        got, want = index.page(page, size), ordering.paginate(rows, order, page, size)
        assert [r.id for r in got.rows.orderBy("_position").collect()] == [r.id for r in want.rows.collect()]
        assert got.info.collect() == want.info.collect()
    plan = index.page(2, 7).rows._jdf.queryExecution().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "PartitionFilters: [isnotnull" in plan
    empty = ordering.PageIndex.build(rows.where("false"), order, str(tmp_path / "none"))
    assert empty.page(1, 5).rows.count() == 0 and empty.page(1, 5).info.first().total_items == 0
