"""Plans and results of operators that once outgrew a task."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from feedlens.operators import corpus, requests, summarize
from feedlens.sources import api, catalog, feeds

TEXTS = [
    ("a", "Wide rivers carry sand to wide deltas. Sand is light, rivers are slow."),
    ("a", "Deltas grow in summer while rivers rest. Nobody counts deltas."),
    (None, "Lone text without a name, lone as can be."),
    ("b", None),
    ("c", ""),
]


def docs(spark):
    rows = spark.createDataFrame(TEXTS, "id string, content string")
    return rows.select("id", "content", F.lit("").alias("title"), F.lit("").alias("summary"), F.array(F.lit("Sands")).alias("tags"))


def plan(df, part="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_sentences_are_scored_without_rows_of_words(spark):
    scored = summarize.score_sentences(docs(spark))
    assert "Aggregate" not in plan(scored) and "Window" not in plan(scored)
    got = {(r.id, r.position): (r.length, round(r.score, 6)) for r in scored.collect()}
    # the two rows of "a" are one document of two places, each scored with the words of both
    assert got == {
        ("a", 0): (39, round(0.3 + 0.7 * 0.2 + 0.5 * 7 / 14, 6)),
        ("a", 1): (31, round(0.15 + 0.7 * 0.2 + 0.5 * 2 / 9, 6)),
        (None, 0): (41, round(0.3 + 0.7 * 0.2 + 0.5 * 3 / 9, 6)),
    }


def test_summaries_do_not_shuffle_the_made_texts(spark):
    made = summarize.summarize(docs(spark))
    below = plan(made).split("Join", 1)[1]
    assert below.count("Generate explode") <= 2  # those of the scored texts; none for the rows of the table
    assert made.count() == len(TEXTS)


def test_terms_are_counted_and_ranked_within_an_article(spark):
    for rows in (corpus.term_frequencies(docs(spark)), corpus.top_terms(docs(spark), 2)):
        assert "Aggregate" not in plan(rows) and "Window" not in plan(rows)
    counts = {(r.id, r.term): r["count"] for r in corpus.term_frequencies(docs(spark)).collect()}
    assert counts[("a", "sands")] == 8 and counts[("a", "sand")] == 2 and counts[("a", "deltas")] == 3
    assert counts[(None, "lone")] == 2 and counts[("c", "sands")] == 4
    best = [(r["rank"], r.term, r["count"]) for r in corpus.top_terms(docs(spark), 2).where("id = 'a'").collect()]
    assert best == [(1, "sands", 8), (2, "deltas", 3)]


def test_keywords_and_tags_are_counted_within_a_document(spark):
    found = summarize.extract_keywords(docs(spark))
    assert "Aggregate" not in plan(found) and "Window" not in plan(found)
    assert {(r.id, r.keyword): r["count"] for r in found.where("id = 'a'").collect()} == {
        ("a", "wide"): 2, ("a", "rivers"): 3, ("a", "sand"): 2, ("a", "deltas"): 3,
    }
    tagged = summarize.fill_tags(docs(spark).withColumn("tags", F.array().cast("array<string>")))
    assert "Window" not in plan(tagged)
    assert {tuple(r.tags) for r in tagged.where("id = 'a'").collect()} == {("deltas", "rivers", "sand", "wide")}


def test_requests_are_not_dealt_by_source(spark):
    asked = spark.createDataFrame([(1, "dev.to, dev.to"), (2, "")], "id int, sources string")
    rows = catalog.resolve_sources(asked, catalog.digest_catalog(spark))
    assert "SortMergeJoin" not in plan(rows, "sparkPlan") and "BroadcastHashJoin" in plan(rows, "sparkPlan")
    assert rows.count() == 6


def test_requests_are_checked_once(spark):
    row = ("2024-01-01", "2024-01-02", "cooking", 0.5, 500, "", "", "dev.to")
    names = "start_date string, end_date string, category string, min_quality double, max_results int, format string, sort_by string, sources string"
    checked = requests.validate_weekly_requests(spark.createDataFrame([row], names), "2024-01-31")
    errors = checked.select(F.explode("errors").alias("e")).where(F.col("e.field").isin("category", "maxResults"))
    assert plan(errors).count("INVALID_RESULT_COUNT") == 1
    assert [r.code for r in errors.select("e.code").collect()] == ["INVALID_CATEGORY", "INVALID_RESULT_COUNT"]


def test_payloads_are_parsed_once(spark):
    rss = "<rss><channel><item><title>A</title></item><item><title>B</title></item></channel></rss>"
    atom = "<feed><entry><id>1</id></entry></feed>"
    rows = [(f"https://{u}", b, [], "", {}, None, 1) for u, b in (("e.com/rss", rss), ("e.com/atom", atom), ("dev.to/api", '[{"id": 1}]'))]
    names = "source_url string, body string, config_tags array<string>, config_language string, config_metadata map<string,string>, fetched_at timestamp, payload_seq long"
    payloads = spark.createDataFrame(rows, names)
    for parse, function, items in (
        (feeds.parse_rss, "from_xml", 2), (feeds.parse_atom, "from_xml", 1), (api.parse_devto_articles, "from_json", 1),
        (api.parse_github_issues, "from_json", 1),
    ):
        parsed = parse(payloads).select("source_type", "id")
        assert plan(parsed).count(function) == 1
        assert parsed.count() == items
