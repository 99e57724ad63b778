"""Discussions scored turn by turn equal their joined text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from feedlens.functions.topic import discussion_topic_relevance
from feedlens.operators.conversations import headers, opening, with_content, with_relevance

SHAPE = "id string, turn long, role string, text string"


@pytest.fixture(scope="module")
def turns(spark):
    draw = random.Random(8)
    words = ["React", "hooks", "re", "act", "é", "日本語キー", "x" * 40, "", "İstanbul", "gatherings", "gath", "\n"]
    rows = []
    for c in range(60):
        for t in range(draw.choice([1, 2, 5, 130])):
            text = " ".join(draw.choice(words) for _ in range(draw.randrange(6)))
            rows.append((str(c), draw.choice([t, t, None]), draw.choice(["user", "assistant"]), draw.choice([text, text, text, None])))
    rows += [("hot", t, "user", "nothing here" if t < 2500 else "at last React") for t in range(3000)]
    return spark.createDataFrame(rows, SHAPE).repartition(7).cache()


@pytest.mark.parametrize("query", ["React hooks", "gatherings", "日本語キー é", "istanbul x", "nothing"])
def test_equals_joined_text(spark, turns, query):
    talks = headers(turns)
    got = {r.id: round(r.relevance, 9) for r in with_relevance(talks, turns, query).collect()}
    whole = with_content(talks, turns).withColumn("relevance", discussion_topic_relevance(query))
    assert got == {r.id: round(r.relevance, 9) for r in whole.collect()}
    assert len(set(got.values())) > 1 and len(got) == 61


def test_opening_is_bounded(turns):
    got = {r.id: r.opening for r in opening(turns).collect()}
    assert len(got["hot"]) < 101 * 14 and got["hot"].startswith("nothing here\nnothing")


def test_no_turns(spark, turns):
    talks = headers(turns.limit(0))
    assert with_relevance(talks, turns, "a").count() == 0
    alone = spark.createDataFrame([("q", "React now")], "id string, title string")
    assert with_relevance(alone, turns, "react").first().relevance == 1.0
    plan = with_relevance(headers(turns), turns, "react")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
