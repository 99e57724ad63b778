"""Tokens, stems and the keyword match score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.text import byte_len, col, trim_space


@dataclass(frozen=True)
class MatchWeights:
    title: float = 3.0
    summary: float = 2.0
    content: float = 1.0
    tag: float = 4.0
    exact: float = 1.5
    partial: float = 0.8


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}]+"), lambda w: w != "")


def stem(c: Column | str) -> Column:
    """Removes the first listed suffix that leaves more than two bytes."""
    word = col(c)
    size = byte_len(word)
    out = F.when(size <= 3, word)
    for suffix in vocab.STEM_SUFFIXES:
        cut = F.substring(word, F.lit(1), F.char_length(word) - len(suffix))
        out = out.when(word.endswith(suffix) & (size > len(suffix) + 2), cut)
    return out.otherwise(word)


def stem_word(word: str) -> str:
    """``stem`` for a driver-side literal such as a query keyword."""
    size = len(word.encode())
    if size <= 3:
        return word
    hit = next((s for s in vocab.STEM_SUFFIXES if word.endswith(s) and size > len(s) + 2), "")
    return word[: len(word) - len(hit)]


def letters_only(word: str) -> str:
    """A keyword as the term table spells it: lower case, letters and spaces."""
    return "".join(ch for ch in word.lower().strip() if ch.isalpha() or ch.isspace()).strip()


def literal_tokens(word: str) -> list[str]:
    """``tokenize`` for a driver-side literal."""
    return "".join(ch if ch.isalpha() else " " for ch in word.lower()).split()


def text_match(folded: Column | str, stems: Column | str, keyword: str, weights: MatchWeights) -> Column:
    """1.5 for the whole keyword, else 0.8 times the share of its tokens found in the text.

    A keyword token takes the value of the first text stem that equals its own (1.0) or
    contains it or is contained in it (0.7).
    """
    body = col(folded)
    parts = [stem_word(t) for t in literal_tokens(keyword)]
    total: Column = F.lit(0.0)
    for part in parts:
        hit = F.get(F.filter(col(stems), _overlaps(part)), F.lit(0))
        total = total + F.when(hit.isNull(), F.lit(0.0)).when(hit == F.lit(part), F.lit(1.0)).otherwise(F.lit(0.7))
    partial = total / F.lit(float(len(parts))) * F.lit(weights.partial) if parts else F.lit(0.0)
    return (
        F.when((body == "") | F.lit(keyword == ""), F.lit(0.0))
        .when(F.contains(body, F.lit(keyword)), F.lit(weights.exact))
        .otherwise(partial)
    )


def _overlaps(part: str):
    literal = F.lit(part)
    return lambda s: F.contains(s, literal) | F.contains(literal, s)


def tag_match(tags: Column | str, keyword: str, weights: MatchWeights) -> Column:
    """The best of exact, substring either way and equal stems over all tags."""
    literal = F.lit(keyword)

    def one(tag: Column) -> Column:
        folded = F.lower(trim_space(tag))
        return (
            F.when(folded == literal, F.lit(weights.exact))
            .when(F.contains(folded, literal) | F.contains(literal, folded), F.lit(weights.partial))
            .when(stem(folded) == F.lit(stem_word(keyword)), F.lit(weights.exact * 0.9))
            .otherwise(F.lit(0.0))
        )

    return F.coalesce(F.array_max(F.transform(col(tags), one)), F.lit(0.0))
