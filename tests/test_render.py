from __future__ import annotations

import json

import pytest
from test_articles import NOW, articles, repos

from feedlens.plans.render import render
from feedlens.plans.trending import trending_repos
from feedlens.sinks import documents
from feedlens.sinks.settings import RenderSettings


@pytest.fixture(scope="module")
def rows(spark):
    a = articles(spark, [
        dict(id="1", title="One_1", url="http://e.com", relevance=0.85, quality=0.75, summary="word " * 60, tags=["x", "y"], metadata={"b": "2", "a": "1"}, content="body"),
        dict(id="2", title="Two", url="", relevance=0.0, quality=0.0),
    ])
    r = repos(spark, [dict(id="r", full_name="o/n", stars=1250, forks=85, description="d", language="Go", trend_score=0.9, url="http://r")])
    return a, r


def report(df):
    return df.first().report


def test_json(rows):
    settings = RenderSettings(metadata=True, content=True)
    items = json.loads(report(documents.render_report(rows[0], "articles", settings, NOW)))
    assert [i["id"] for i in items] == ["1", "2"] and list(items[0]) == sorted(items[0])
    assert items[0]["metadata"] == {"a": "1", "b": "2"} and "metadata" not in items[1] and items[0]["summary"].endswith("...")
    both = json.loads(report(documents.render_mixed(*rows, RenderSettings(), NOW)))
    assert both["summary"] == {"timestamp": "2024-06-01 12:00:00", "total_articles": 2, "total_repositories": 1}


def test_markdown(rows):
    text = report(documents.render_report(rows[0], "articles", RenderSettings(output="markdown", metadata=True), NOW))
    assert text.startswith("# Articles\n\n*Generated on 2024-06-01 12:00:00*\n\n**Total Articles:** 2\n\n---\n\n### 1. [One\\_1](http://e.com)\n\n| Field | Value |")
    assert "| **Relevance** | 85.0% |\n| **Quality** | 75.0% |\n" in text and "**Tags:** `x`, `y`\n\n" in text
    assert "- **a:** 1\n- **b:** 2\n\n\n---\n\n### 2. Two\n\n" in text and "Relevance** | 0" not in text
    code = report(documents.render_report(rows[1], "repositories", RenderSettings(output="markdown"), NOW))
    assert "| **Stars** | ⭐ 1250 |\n| **Forks** | 🍴 85 |\n" in code and "🌟 **Very Popular**" in code and "🚀 **Very Active**" in code


def test_text(rows):
    full = report(documents.render_mixed(*rows, RenderSettings(output="text"), NOW))
    assert full.startswith("=" * 46 + "\n  DEVELOPMENT CONTEXT REPORT (3 items)\n") and "    Status: Very Popular, Very Active\n" in full
    assert "SUMMARY:\n  Articles:     2\n  Repositories: 1\n  Total Items:  3\n" in full
    short = report(documents.render_report(rows[0], "articles", RenderSettings(output="text", compact=True), NOW))
    assert short == "ARTICLES (2 items)\nGenerated: 2024-06-01 12:00:00\n\n1. One_1 (http://e.com) [s] R:85.0 Q:75.0\n\n2. Two [s]\n\n"


def test_nothing_to_show(rows):
    none = rows[0].where("false")
    assert report(documents.render_report(none, "articles", RenderSettings(), NOW)) == "[]"
    assert report(documents.render_report(none, "articles", RenderSettings(output="text"), NOW)) == "No articles found.\n"
    assert "Articles](#articles)" not in report(documents.render_mixed(none, rows[1], RenderSettings(output="markdown"), NOW))


def test_batches(spark, rows, tmp_path):
    many = articles(spark, [dict(id=f"{i:03d}", title=f"t{i:03d}") for i in range(230)])
    settings = RenderSettings(output="text", sort_by="title", sort_order="asc")
    got = documents.render_batches(many, "articles", settings, NOW).orderBy("batch").collect()
    assert [(r.batch, r["items"]) for r in got] == [(0, 100), (1, 100), (2, 30)]
    assert "[1] t200\n" in got[2].body and documents.batch_joiner(settings).startswith("\n-")
    documents.write_batches(documents.render_batches(many, "articles", settings, NOW), str(tmp_path / "out"), settings)
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).count() >= 1


def test_render_result_and_registry(spark, rows):
    result = trending_repos(rows[1], NOW).reuse()
    assert json.loads(report(render(result, NOW)))[0]["fullName"] == "o/n"
    assert report(render(result, NOW, "markdown")).startswith("# Repositories")
    result.release()
    assert documents.renderer_for("pdf") is documents.renderer_for("json")


def test_json_batches_are_one_list(spark):
    many = articles(spark, [dict(id=str(i), title=f"t{i:03d}") for i in range(250)])
    settings = RenderSettings(sort_by="title", sort_order="asc")
    whole = documents.combined_batches(documents.render_batches(many, "articles", settings, NOW), settings)
    bodies = [r.body for r in whole.orderBy("batch").collect()]
    assert len(bodies) == 3 and [i["id"] for i in json.loads("".join(bodies))] == [str(i) for i in range(250)]
