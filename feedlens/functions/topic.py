"""Relevance of articles, repositories and discussions to a search query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.scores import unit
from feedlens.functions.text import col, cut_bytes


#: A keyword within the first bytes of a text counts as early.
HEAD_BYTES = 100


def query_keywords(query: str) -> list[str]:
    return query.lower().split()


def half_hit(body: Column, keyword: str) -> Column:
    """True when either byte half of a keyword over four bytes occurs in the text."""
    raw = keyword.encode()
    if len(raw) <= 4:
        return F.lit(False)
    if keyword.isascii():
        front, back = keyword[: len(raw) // 2], keyword[len(raw) // 2 :]
    else:  # a half may end inside a character, so compare bytes
        body = F.encode(body, "UTF-8")
        front, back = raw[: len(raw) // 2], raw[len(raw) // 2 :]
    return F.contains(body, F.lit(front)) | F.contains(body, F.lit(back))


@dataclass(frozen=True)
class Match:
    """What a text shows of a keyword: held at all, at its start, in its head, or only by half."""

    found: Column
    first: Column
    early: Column
    half: Column


def relevance_of(matches: list[Match]) -> Column:
    """How early and how completely the keywords occur, 0.1 to 1; 0.5 without keywords."""
    if not matches:
        return F.lit(0.5)
    total: Column = F.lit(0.0)
    hits: Column = F.lit(0)
    for m in matches:
        place = F.when(m.first, F.lit(1.0)).when(m.early, F.lit(0.8)).otherwise(F.lit(0.6))
        total = (
            total
            + F.when(m.found, place).otherwise(F.lit(0.0))
            + F.when(m.half, F.lit(0.3)).otherwise(F.lit(0.0))
        )
        hits = hits + m.found.cast("int")
    n = F.lit(float(len(matches)))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), total / n + hits.cast("double") / n * F.lit(0.2)))


def text_relevance(c: Column | str, keywords: list[str]) -> Column:
    """How early and how completely the keywords occur in the text, 0.1 to 1."""
    body = F.lower(col(c))
    head = cut_bytes(body, HEAD_BYTES)
    words = [(k, F.lit(k)) for k in keywords]
    return relevance_of(
        [Match(F.contains(body, w), F.startswith(body, w), F.contains(head, w), half_hit(body, k)) for k, w in words]
    )


def tag_relevance(tags: Column | str, keywords: list[str]) -> Column:
    if not keywords:
        return F.lit(0.0)
    words = F.array(*[F.lit(k) for k in keywords])

    def pair(tag: Column, word: Column) -> Column:
        return (
            F.when(tag == word, F.lit(1.0))
            .when(F.contains(tag, word), F.lit(0.7))
            .when(F.contains(word, tag), F.lit(0.5))
            .otherwise(F.lit(0.0))
        )

    def one(total: Column, tag: Column) -> Column:
        return F.aggregate(words, total, lambda acc, word: acc + pair(F.lower(tag), word))

    score = F.aggregate(F.coalesce(col(tags), F.array().cast("array<string>")), F.lit(0.0), one)
    return F.least(score / F.lit(float(len(keywords))), F.lit(1.0))


def tech_relevance(c: Column | str, query: str, weights: dict[str, float] | None = None) -> Column:
    """The highest weight among the technology words that query and text share."""
    table = vocab.TECH_WEIGHTS if weights is None else weights
    body = F.lower(col(c))
    shared = {word: w for word, w in table.items() if word in query.lower()}
    out: Column = F.lit(0.0)
    for word, weight in shared.items():
        out = F.greatest(out, F.when(F.contains(body, F.lit(word)), F.lit(weight)).otherwise(F.lit(0.0)))
    return out


def language_relevance(c: Column | str, query: str) -> Column:
    """1 when the query names the language, 0.9 when it names an alias of it."""
    language = F.lower(col(c))
    folded = query.lower()
    out = F.when(language == "", F.lit(0.0)).when(F.contains(F.lit(folded), language), F.lit(1.0))
    named = [lang for lang, aliases in vocab.LANGUAGE_ALIASES.items() if any(a in folded for a in aliases)]
    if named:
        out = out.when(language.isin(named), F.lit(0.9))
    return out.otherwise(F.lit(0.0))


def popularity_score(stars: Column | str = "stars") -> Column:
    c = col(stars).cast("double")
    return F.when(c <= 0, F.lit(0.0)).otherwise(unit(F.log10(c) / F.lit(3.0) * F.lit(0.5)))


def _floor_tenth(c: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), c))


def article_topic_relevance(query: str, tech_weights: dict[str, float] | None = None) -> Column:
    keywords = query_keywords(query)
    body = F.concat_ws(" ", "title", "summary")
    return _floor_tenth(
        text_relevance(body, keywords) * F.lit(0.5)
        + tag_relevance("tags", keywords) * F.lit(0.3)
        + tech_relevance(body, query, tech_weights) * F.lit(0.2)
    )


def repo_topic_relevance(query: str) -> Column:
    body = F.concat_ws(" ", "name", "description")
    return _floor_tenth(
        text_relevance(body, query_keywords(query)) * F.lit(0.6)
        + language_relevance("language", query) * F.lit(0.3)
        + popularity_score("stars") * F.lit(0.1)
    )


def discussion_topic_relevance(query: str) -> Column:
    return text_relevance(F.concat_ws(" ", "title", "content"), query_keywords(query))
