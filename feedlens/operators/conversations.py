"""Discussions whose text stays spread over the rows of their turns.

Every measure of a discussion is put together from what its turns show one by one, so a
conversation of any length is combined before the shuffle and never lies in one row or task.
A turn table has (id, turn, role, text); the order of a conversation is ``turn``, then ``text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.text import cut_bytes
from feedlens.functions.topic import HEAD_BYTES, Match, half_hit, query_keywords, relevance_of


def headers(turns: DataFrame) -> DataFrame:
    """(id, title, score, replies): the first user turn, the answers, and the turns after the first."""
    return turns.groupBy("id").agg(
        F.coalesce(F.min_by("text", F.when(F.col("role") == "user", F.struct("turn", "text"))), F.lit("")).alias("title"),
        F.count_if(F.col("role") == "assistant").alias("score"),
        (F.count(F.lit(1)) - 1).alias("replies"),
    )


def opening(turns: DataFrame, n: int = HEAD_BYTES) -> DataFrame:
    """(id, opening): the turns joined by newlines, complete for the first ``n`` bytes at least.

    Each turn adds a byte or more, so n + 1 turns are enough, and n characters of each; Spark takes these
    few before it shuffles.
    """
    first = Window.partitionBy("id").orderBy("turn", "text")
    few = turns.filter("text IS NOT NULL").withColumn("_row", F.row_number().over(first)).filter(F.col("_row") <= n + 1)
    parts = F.array_sort(F.collect_list(F.struct("_row", F.substring("text", 1, n).alias("text"))))
    return few.groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("opening"))


def keyword_hits(turns: DataFrame, keywords: list[str]) -> DataFrame:
    """(id, hit_0, half_0, ...): whether any turn holds the keyword, or half of a long one.

    Keywords hold no white space, so none reaches from one turn into the next.
    """
    body = F.lower("text")
    flags = [c for i, k in enumerate(keywords) for c in (F.contains(body, F.lit(k)).alias(f"hit_{i}"), half_hit(body, k).alias(f"half_{i}"))]
    any_turn = [F.bool_or(f"{kind}_{i}").alias(f"{kind}_{i}") for i in range(len(keywords)) for kind in ("hit", "half")]
    return turns.select("id", *flags).groupBy("id").agg(F.count(F.lit(1)).alias("_turns"), *any_turn).drop("_turns")


def with_relevance(discussions: DataFrame, turns: DataFrame, query: str, name: str = "relevance") -> DataFrame:
    """Adds the relevance of title and turns to the query, the same number as for the joined text."""
    keywords = query_keywords(query)
    joined = discussions.join(keyword_hits(turns, keywords), "id", "left").join(opening(turns), "id", "left")
    title = F.lower("title")
    head = cut_bytes(F.lower(F.concat_ws(" ", "title", "opening")), HEAD_BYTES)

    def match(i: int, keyword: str) -> Match:
        word = F.lit(keyword)
        return Match(
            found=F.contains(title, word) | F.coalesce(f"hit_{i}", F.lit(False)),
            first=F.startswith(title, word),
            early=F.contains(head, word),
            half=half_hit(title, keyword) | F.coalesce(f"half_{i}", F.lit(False)),
        )

    score: Column = relevance_of([match(i, k) for i, k in enumerate(keywords)])
    return joined.select(*[c for c in discussions.columns if c != name], score.alias(name))


def with_content(discussions: DataFrame, turns: DataFrame) -> DataFrame:
    """Adds the whole text; for the few rows of a result that is shown, as one text is what it shows."""
    wanted = turns.filter("text IS NOT NULL").join(F.broadcast(discussions.select("id")), "id", "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    texts = wanted.groupBy("id").agg(F.array_join(F.transform(parts, lambda t: t["text"]), "\n").alias("content"))
    return discussions.join(texts, "id", "left").withColumn("content", F.coalesce("content", F.lit("")))
