"""Feeds of many readers, whose preferences are a table.

Every item is matched once with the topics of all readers. Items that hold the same topics are
alike for every reader but for their own score, so of each such class only its best items can
reach a feed; and readers who share topics and weights share a feed until the end. Readers
and classes meet over the topics, never readers and items.

A preferences table has reader_id, favorite_topics, topic_weights (map), preferred_sources, recency
and languages; null lists are empty, a null recency is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.arrays import empty_strings
from feedlens.functions.scores import time_decay
from feedlens.operators.matching import automaton, found_terms, term_blocks

_CLASS = ["_topics", "_trait"]


def with_topics(items: DataFrame, fields: Column, topics: DataFrame, name: str = "_topics") -> DataFrame:
    """Adds the lower-case topics (a one-column table) that occur in any of the texts of an array, in order.

    The empty topic occurs everywhere. Only the given columns travel through Python.
    """
    out = items.withColumn(name, empty_strings())
    column = topics.columns[0]
    for block in term_blocks(topics, column):
        words = [word for (word,) in block]
        held = items.sparkSession.sparkContext.broadcast((words, automaton(words)))
        ready = out.withColumn("_fields", F.transform(fields, lambda f: F.lower(f)))
        kept = out.columns

        def run(batches: Iterator[pa.RecordBatch], held=held, kept=kept) -> Iterator[pa.RecordBatch]:
            words, machine = held.value
            always = {0} if words[0] == "" else set()
            for batch in batches:
                lists = []
                for before, texts in zip(batch.column(name).to_pylist(), batch.column("_fields").to_pylist(), strict=True):
                    found = set(always)
                    for text in texts:
                        found |= found_terms(machine, None, text)
                    lists.append(sorted([*before, *(words[i] for i in found)]))
                columns = [pa.array(lists, pa.list_(pa.string())) if c == name else batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays(columns, kept)

        out = ready.mapInArrow(run, out.schema)
    return out


def _profiles(prefs: DataFrame, weight: Column, liked: Column) -> DataFrame:
    """The readers with ``_profile``: topics in lower case, their weights, and the traits that are liked."""
    given = F.coalesce("favorite_topics", empty_strings())
    weights = F.coalesce("topic_weights", F.create_map().cast("map<string,double>"))
    listed = F.transform(given, lambda t: F.struct(F.lower(t).alias("topic"), weights[t].alias("custom")))
    listed = F.filter(listed, lambda x: x["topic"].isNotNull())
    listed = F.transform(listed, lambda x: F.struct(x["topic"].alias("topic"), (x["custom"] * weight).alias("weight")))
    profile = F.struct(listed.alias("topics"), F.array_sort(F.array_distinct(liked)).alias("liked"))
    return prefs.select(profile.alias("_profile"), "reader_id", "preferred_sources", "recency")


def _feeds(
    items: DataFrame, fields: Column, id_col: str, score_col: str, trait: Column, prefs: DataFrame, default: float, liked_bonus: float, k: int
) -> DataFrame:
    """(_profile, rank, topic, boosted, and the columns of the items): the best ``k`` items of each profile."""
    profiles = prefs.select("_profile").distinct()
    spots = profiles.select("_profile", F.posexplode("_profile.topics").alias("_at", "_spot"))
    spots = spots.select("_profile", "_at", F.col("_spot.topic").alias("topic"), F.coalesce("_spot.weight", F.lit(default)).alias("_boost"))
    matched = with_topics(items, fields, spots.select("topic").distinct()).filter(F.size("_topics") > 0).withColumn("_trait", trait)
    best = Window.partitionBy(*_CLASS).orderBy(F.desc(score_col), id_col)
    top = matched.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= k).drop("_place")
    classes = top.select(*_CLASS).distinct().select(*_CLASS, F.explode("_topics").alias("topic"))
    met = spots.join(classes, "topic")
    earlier = F.transform(F.slice("_profile.topics", F.lit(1), F.col("_at")), lambda x: x["topic"])
    first = met.filter(~F.arrays_overlap(earlier, "_topics"))
    bonus = F.when(F.array_contains("_profile.liked", F.col("_trait")), F.lit(liked_bonus)).otherwise(F.lit(0.0))
    scored = first.withColumn("_bonus", bonus).join(top, _CLASS)
    scored = scored.withColumn("boosted", F.least(F.least(F.col(score_col) + F.col("_bonus"), F.lit(1.0)) + F.col("_boost"), F.lit(1.0)))
    order = Window.partitionBy("_profile").orderBy(F.desc("boosted"), F.desc(score_col), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop(*_CLASS, "_at", "_boost", "_bonus")


def article_feeds(articles: DataFrame, prefs: DataFrame, as_of: datetime | str, k: int = 20, id_col: str = "id") -> DataFrame:
    """(reader_id, rank, id, topic, relevance, quality): for each reader the ``k`` best articles on a favourite topic.

    The first favourite topic that occurs in title, summary or tags raises the relevance by its weight (0.1 by
    default), a preferred source and the recency preference the quality, each up to 1, as in
    ``personalize_articles``. The order is raised relevance, own relevance, id. Readers without a topic that
    occurs have no rows; each row of a repeated reader gets a feed.
    """
    known = _profiles(prefs, F.lit(1.0), empty_strings())
    slim = articles.select(F.col(id_col).alias("id"), "title", "summary", "tags", "source", "published_at", "relevance", "quality")
    fields = F.concat(F.array("title", "summary"), F.coalesce("tags", empty_strings()))
    best = _feeds(slim, fields, "id", "relevance", F.lit(""), known, 0.1, 0.0, k)
    rows = known.join(best, "_profile")
    preferred = F.array_contains(F.coalesce("preferred_sources", empty_strings()), F.col("source"))
    quality = F.when(preferred, F.least(F.col("quality") + 0.1, F.lit(1.0))).otherwise(F.col("quality"))
    recency = F.coalesce("recency", F.lit(0.0))
    quality = F.when(recency > 0, F.least(quality + time_decay(as_of) * recency * F.lit(0.1), F.lit(1.0))).otherwise(quality)
    return rows.select("reader_id", "rank", "id", "topic", F.col("boosted").alias("relevance"), quality.alias("quality"))


def repository_feeds(repos: DataFrame, prefs: DataFrame, k: int = 20, id_col: str = "id") -> DataFrame:
    """(reader_id, rank, id, topic, trend_score): for each reader the ``k`` best repositories on a favourite topic.

    A preferred language raises the trend score by 0.1, then the first favourite topic that occurs in name,
    description or full name by half its weight (0.05 by default), each up to 1, as in ``personalize_repos``.
    """
    liked = F.transform(F.coalesce("languages", empty_strings()), lambda x: F.lower(x))
    known = _profiles(prefs, F.lit(0.5), liked)
    slim = repos.select(F.col(id_col).alias("id"), "name", "description", "full_name", "language", "trend_score")
    fields = F.array("name", "description", "full_name")
    best = _feeds(slim, fields, "id", "trend_score", F.lower("language"), known, 0.05, 0.1, k)
    return known.join(best, "_profile").select("reader_id", "rank", "id", "topic", F.col("boosted").alias("trend_score"))
