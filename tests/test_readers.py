"""Feeds of many readers against one reader at a time."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from feedlens.operators.personalize import Preferences, personalize_articles, personalize_repos
from feedlens.operators.readers import article_feeds, repository_feeds
from test_articles import NOW, articles, repos

PREFS = (
    "reader_id long, favorite_topics array<string>, topic_weights map<string,double>, preferred_sources array<string>, "
    "recency double, languages array<string>, id string, topic string"
)
WORDS = ["React", "hooks", "css", "Grid", "node", "", "日本"]


@pytest.fixture(scope="module")
def readers(spark):
    draw = random.Random(1)
    rows = []
    for r in range(25):
        topics = [draw.choice([*WORDS[:5], "Rea", "o"]) for _ in range(draw.randrange(4))]
        weights = {t: draw.choice([0.3, 0.02, 0.7]) for t in topics if draw.random() < 0.6}
        rows.append((r, topics, weights, draw.sample(["s", "p", "q"], 1), draw.choice([0.0, 0.5, None]), draw.sample(["Go", "css", "JS"], 2), "x", "y"))
    rows += [(90, None, None, None, None, None, "x", "y"), (91, [None, "css"], None, ["s"], 1.0, None, "x", "y"), (91, [None, "css"], None, ["s"], 1.0, None, "x", "y"), (92, [""], {"": 0.5}, [], 0.0, [], "x", "y")]
    return spark.createDataFrame(rows, PREFS), rows


def _text(draw):
    return " ".join(draw.choice(WORDS) for _ in range(3))


def test_article_feeds(spark, readers):
    draw = random.Random(2)
    rows = articles(
        spark,
        [dict(id=f"a{i:03}", title=_text(draw), summary=draw.choice(["", _text(draw)]), tags=[draw.choice(WORDS)], source=draw.choice("spq"),
              relevance=draw.choice([0.2, 0.9, 0.5]), quality=draw.random(), published_at=NOW - timedelta(hours=9 * i)) for i in range(80)],
    )
    table, prefs = readers
    got = {}
    for r in article_feeds(rows, table, NOW, k=6).collect():
        got.setdefault(r.reader_id, []).append((r.rank, r.id, round(r.relevance, 9), round(r.quality, 9), r.topic))
    base = {r.id: r for r in rows.collect()}
    for reader, topics, weights, sources, recency, *_ in prefs:
        topics = [t for t in topics or [] if t is not None]
        one = personalize_articles(rows, Preferences(topics, sources or [], weights or {}, recency or 0.0), NOW).collect()
        has = lambda r, t: any(t.lower() in x.lower() for x in (r.title, r.summary, *r.tags))
        kept = [r for r in one if any(has(r, t) for t in topics)]
        kept.sort(key=lambda r: (-r.relevance, -base[r.id].relevance, r.id))
        want = [(i, r.id, round(r.relevance, 9), round(r.quality, 9), next(t.lower() for t in topics if has(r, t))) for i, r in enumerate(kept[:6], 1)]
        assert sorted(set(got.get(reader, []))) == want
    assert len(got[91]) == 12  # a repeated reader


def test_repository_feeds(spark, readers):
    draw = random.Random(3)
    rows = repos(
        spark,
        [dict(id=f"r{i:03}", name=draw.choice(WORDS), description=_text(draw), full_name=f"o/{draw.choice(WORDS)}", language=draw.choice(["GO", "CSS", ""]),
              trend_score=draw.choice([0.3, 0.95, 0.6])) for i in range(70)],
    )
    table, prefs = readers
    got = {}
    for r in repository_feeds(rows, table, k=5).collect():
        got.setdefault(r.reader_id, []).append((r.rank, r.id, round(r.trend_score, 9)))
    base = {r.id: r for r in rows.collect()}
    for reader, topics, weights, _, _, languages, *_ in prefs:
        topics = [t for t in topics or [] if t is not None]
        one = personalize_repos(rows, Preferences(topics, [], weights or {}, 0.0, languages or [])).collect()
        kept = [r for r in one if any(t.lower() in x.lower() for t in topics for x in (r.name, r.description, r.full_name))]
        kept.sort(key=lambda r: (-r.trend_score, -base[r.id].trend_score, r.id))
        assert sorted(set(got.get(reader, []))) == [(i, r.id, round(r.trend_score, 9)) for i, r in enumerate(kept[:5], 1)]


def test_no_readers_or_items(spark, readers):
    rows = articles(spark, [dict(id="a", title="React")])
    assert article_feeds(rows, readers[0].limit(0), NOW).count() == 0
    assert article_feeds(rows.where(F.lit(False)), readers[0], NOW).count() == 0
