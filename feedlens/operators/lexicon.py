"""Relevance of articles to a weighted word list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.scores import points
from feedlens.functions.text import ascii_lower


def lexicon_relevance(
    articles: DataFrame,
    query: str = "",
    lexicon: dict[str, float] | None = None,
    source_bonus: dict[str, float] | None = None,
) -> DataFrame:
    """Sets ``relevance``: weights of the words found, a query bonus and a source bonus.

    A word counts 1.5 times in the title, once in the content and 1.2 times per tag that
    equals it. The first matching source of ``source_bonus`` counts. The folded texts are
    columns of their own so that each row folds its content once for all words.
    """
    lexicon = vocab.RELEVANCE_LEXICON if lexicon is None else lexicon
    source_bonus = vocab.SOURCE_BONUS if source_bonus is None else source_bonus
    folded = articles.withColumns({"_title": ascii_lower("title"), "_content": ascii_lower("content")})

    def found(where: str, needle: str) -> Column:
        return F.contains(F.col(where), F.lit(_fold(needle))) if needle else F.lit(False)

    score: Column = F.lit(0.0)
    for word, weight in lexicon.items():
        score = score + points(found("_title", word), weight * 1.5)
    for word, weight in lexicon.items():
        score = score + points(found("_content", word), weight)
    for word, weight in lexicon.items():
        score = score + _uses("tags", word) * F.lit(weight * 1.2)
    score = score + points(found("_title", query), 0.3) + points(found("_content", query), 0.2)
    source = ascii_lower("source")
    bonus = F.when(F.lit(False), F.lit(0.0))
    for name, value in source_bonus.items():
        bonus = bonus.when(F.contains(source, F.lit(_fold(name))), F.lit(value))
    score = score + bonus.otherwise(F.lit(0.0))
    return folded.withColumn("relevance", F.least(score, F.lit(1.0))).drop("_title", "_content")


def _uses(tags: str, word: str) -> Column:
    return F.size(F.filter(F.col(tags), lambda tag: tag == F.lit(word)))


def _fold(word: str) -> str:
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in word)
