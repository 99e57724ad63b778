"""Extractive summaries, keywords and content quality."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.arrays import pin, total_of
from feedlens.functions.scores import points, unit
from feedlens.functions.text import UNICODE_SPACE, byte_len, col, plain_text, trim_space, word_count, words
from feedlens.functions.times import is_recent
from feedlens.operators.tally import (
    COUNTS,
    SENTENCES,
    by_document,
    in_id_order,
    read_keywords,
    read_sentences,
    spaced,
)


def extract_sentences(c: Column | str) -> Column:
    """Parts between sentence ends that have more than ten bytes."""
    parts = F.transform(F.split(col(c), r"[.!?]+[\t\n\f\r ]+"), lambda s: trim_space(s))
    return F.filter(parts, lambda s: byte_len(s) > 10)


def keyword_counts(docs: DataFrame, column: str = "content") -> DataFrame:
    """(id, words): the keywords of each document with their uses, a row for each document that has any."""
    placed = in_id_order(docs.select("id", column))
    return by_document(placed, spaced(column, f"{UNICODE_SPACE}+"), read_keywords, f"words {COUNTS}")


def extract_keywords(docs: DataFrame, column: str = "content") -> DataFrame:
    """(id, keyword, count) of each document."""
    return keyword_counts(docs, column).select("id", F.inline("words").alias("keyword", "count"))


def length_score(sentence: Column | str) -> Column:
    return _length_points(F.char_length(col(sentence)))


def _length_points(n: Column) -> Column:
    return (
        F.when(n.between(50, 200), F.lit(1.0))
        .when(n < 20, F.lit(0.2))
        .when(n > 300, F.lit(0.3))
        .otherwise(F.lit(0.7))
    )


def score_sentences(
    docs: DataFrame,
    column: str = "content",
    position_weight: float = 0.3,
    length_weight: float = 0.2,
    keyword_weight: float = 0.5,
) -> DataFrame:
    """(id, position, length, score) of each sentence.

    A sentence word counts when it is a keyword of the whole text. A document is read at once,
    so its words are neither shuffled nor kept in a table; rows are shuffled by id only.
    """
    parts = F.transform(
        extract_sentences(column),
        lambda s, i: F.struct(
            i.alias("place"), F.char_length(s).alias("length"), spaced(s, f"{UNICODE_SPACE}+").alias("text")
        ),
    )
    texts = F.struct(spaced(column, f"{UNICODE_SPACE}+").alias("whole"), parts.alias("parts"))
    counted = by_document(in_id_order(docs.select("id", column)), texts, read_sentences, SENTENCES)
    per_part = counted.select("id", "has_keywords", F.size("sentences").alias("n"), F.inline("sentences"))
    share = F.when(F.col("has_keywords"), F.col("hits") / F.col("total")).otherwise(F.lit(0.5))
    score = (
        (F.lit(1.0) - F.col("place").cast("double") / F.col("n")) * F.lit(position_weight)
        + _length_points(F.col("length")) * F.lit(length_weight)
        + share * F.lit(keyword_weight)
    )
    return per_part.select(
        "id", F.col("place").cast("long").alias("position"), F.col("length").cast("long"), score.alias("score")
    )


def best_positions(scores: DataFrame, k: int = 2) -> DataFrame:
    """(id, places): the positions of the ``k`` best sentences in text order.

    Ties go to the earlier sentence. Each array has ``k`` elements at most.
    """
    order = Window.partitionBy("id").orderBy(F.round("score", 9).desc(), "position")
    return (
        scores.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("position")).alias("places"))
    )


def fit_length(c: Column | str, limit: int = 150) -> Column:
    """Text over ``limit`` bytes keeps whole words up to ``limit - 3`` and gets "..."."""
    value = col(c)
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(acc: Column, word: Column) -> Column:
        longer = F.when(acc["out"] == "", word).otherwise(F.concat(acc["out"], F.lit(" "), word))
        full = acc["full"] | (byte_len(longer) > limit - 3)
        return F.struct(F.when(full, acc["out"]).otherwise(longer).alias("out"), full.alias("full"))

    cut = F.aggregate(
        words(value),
        start,
        step,
        lambda acc: F.when(acc["full"] & (acc["out"] != ""), F.concat(acc["out"], F.lit("..."))).otherwise(acc["out"]),
    )
    return F.when(byte_len(value) <= limit, value).otherwise(cut)


def summarize(
    docs: DataFrame,
    column: str = "content",
    min_bytes: int = 50,
    max_bytes: int = 150,
    sentences: int = 2,
) -> DataFrame:
    """Adds ``generated_summary`` and ``summary_error`` (NULL = good).

    Short texts come back cleaned; up to ``sentences`` sentences are joined uncut; longer
    texts give their best sentences, shortened to ``max_bytes``.
    """
    cleaned = pin(docs, _clean=plain_text(column))
    cleaned = pin(cleaned, _sentences=extract_sentences("_clean"))
    count = F.size("_sentences")
    # only texts with more sentences than wanted have a choice to make
    long_texts = cleaned.where(count > sentences).select("id", "_clean")
    chosen = best_positions(score_sentences(long_texts, "_clean"), sentences)
    picked = F.transform("places", lambda p: F.get(F.col("_sentences"), p.cast("int")))
    error = F.when(F.col(column) == "", "text cannot be empty").when(
        (byte_len("_clean") >= min_bytes) & (count == 0), "no sentences found in text"
    )
    summary = (
        F.when(error.isNotNull(), F.lit(""))
        .when(byte_len("_clean") < min_bytes, F.col("_clean"))
        .when(count <= sentences, F.array_join("_sentences", " "))
        .otherwise(fit_length(F.array_join(picked, " "), max_bytes))
    )
    # the text is shuffled once more as it came, and cleaned again rather than shuffled three times
    joined = pin(docs.join(chosen, "id", "left"), _clean=plain_text(column))
    joined = pin(joined, _sentences=extract_sentences("_clean"))
    return pin(joined, generated_summary=summary, summary_error=error).drop("_clean", "_sentences", "places")


def clean_articles(df: DataFrame) -> DataFrame:
    """Cleans title, content, summary and tags; ``error`` is set when no title is left."""
    # a tag cannot hold U+001F, so one cleaning of the joined tags serves all of them
    tags = F.split(plain_text(F.array_join("tags", "\x1f")), "\x1f")
    cleaned = df.withColumns(
        {
            "title": plain_text("title"),
            "content": plain_text("content"),
            "summary": plain_text("summary"),
            "tags": F.filter(F.transform(tags, lambda t: trim_space(t)), lambda t: t != ""),
        }
    )
    return cleaned.withColumn("error", F.when(F.col("title") == "", "title cannot be empty after cleaning"))


# --- quality ----------------------------------------------------------------------------


def completeness() -> Column:
    return F.least(
        points(F.col("title") != "", 0.3)
        + points(F.col("url") != "", 0.1)
        + points(F.col("source") != "", 0.1)
        + points(F.col("summary") != "", 0.2)
        + points(F.col("content") != "", 0.2)
        + points(F.size("tags") > 0, 0.1),
        F.lit(1.0),
    )


def has_more_letters(c: Column | str, n: int, first: int = 300) -> Column:
    """More than ``n`` distinct letters and digits: something is left once ``n`` are removed.

    The first characters of a text mostly show that many, and the rest is not looked at then.
    """

    def more(text: Column) -> Column:
        letters = F.regexp_replace(text, r"[^\p{L}\p{Nd}]+", "")
        rest = F.aggregate(
            F.sequence(F.lit(1), F.lit(n)), letters, lambda left, _: F.replace(left, F.left(left, F.lit(1)), F.lit(""))
        )
        return rest != ""

    return F.when(more(F.left(col(c), F.lit(first))), F.lit(True)).otherwise(more(col(c)))


def length_variety(counts: str, mean: str) -> Column:
    """Spread of the sentence lengths relative to their mean; 0.5 for a single sentence.

    ``mean`` is a column of its own, so that it is not computed again for each element.
    """
    values, n, mid = F.col(counts), F.size(counts).cast("double"), F.col(mean)
    variance = total_of(F.transform(values, lambda x: (x - mid) * (x - mid))) / n
    return F.when(F.size(counts) <= 1, F.lit(0.5)).otherwise(F.least(F.sqrt(variance) / mid, F.lit(1.0)))


def readability(df: DataFrame, out: str = "readability") -> DataFrame:
    """Adds the readability of the content, else the summary, else the title."""
    body = F.when(F.col("content") != "", F.col("content")).when(F.col("summary") != "", F.col("summary"))
    staged = df.withColumn("_body", body.otherwise(F.col("title")))
    lengths = F.transform(extract_sentences("_body"), lambda s: word_count(s).cast("double"))
    staged = pin(staged, _lengths=lengths, _words=word_count("_body"), _varied=has_more_letters("_body", 20))
    staged = pin(staged, _mean=total_of(F.col("_lengths")) / F.greatest(F.size("_lengths"), F.lit(1)))
    sentence_count = F.size("_lengths")
    per_sentence = F.col("_words") / sentence_count
    score = F.least(
        F.when(per_sentence.between(10, 25), F.lit(0.4)).otherwise(F.lit(0.2))
        + F.when(F.col("_varied"), F.lit(0.3)).otherwise(F.lit(0.1))
        + length_variety("_lengths", "_mean") * F.lit(0.3),
        F.lit(1.0),
    )
    usable = (F.col("_words") > 0) & (sentence_count > 0)
    return staged.withColumn(out, F.when(usable, score).otherwise(F.lit(0.0))).drop("_body", "_lengths", "_words", "_varied", "_mean")


def topical_relevance(as_of: datetime | str) -> Column:
    return F.least(
        F.lit(0.5)
        + points(F.size("tags") > 0, 0.2)
        + points(is_recent("published_at", as_of, 7), 0.2)
        + points(byte_len("content") > 500, 0.1),
        F.lit(1.0),
    )


def assess_quality(df: DataFrame, as_of: datetime | str) -> DataFrame:
    """Sets ``quality`` from completeness, readability and relevance."""
    scored = readability(df, "_readability")
    score = (
        completeness() * F.lit(0.4)
        + F.col("_readability") * F.lit(0.3)
        + topical_relevance(as_of) * F.lit(0.3)
    )
    return scored.withColumn("quality", unit(score)).drop("_readability")


# --- jobs -------------------------------------------------------------------------------


def fill_summaries(df: DataFrame) -> DataFrame:
    """Generates the summary of articles that have content but none; failures stay empty."""
    source = F.when((F.col("summary") == "") & (F.col("content") != ""), F.col("content")).otherwise("")
    made = summarize(df.withColumn("_source", source), "_source")
    summary = F.when(F.col("summary") == "", F.col("generated_summary")).otherwise(F.col("summary"))
    return made.withColumn("summary", summary).drop("_source", "generated_summary", "summary_error")


def fill_tags(df: DataFrame, n: int = 5) -> DataFrame:
    """Untagged articles get their ``n`` most frequent keywords, ties in word order."""
    words_of = keyword_counts(df.where(F.size("tags") == 0).select("id", "content"))
    ranked = F.sort_array(F.transform("words", lambda k: F.struct((-k["n"]).alias("uses"), k["word"].alias("word"))))
    best = words_of.select("id", F.transform(F.slice(ranked, 1, n), lambda k: k["word"]).alias("_best"))
    tags = F.when(F.size("tags") == 0, F.coalesce("_best", F.col("tags"))).otherwise(F.col("tags"))
    return df.join(best, "id", "left").withColumn("tags", tags).drop("_best")


def process_article(df: DataFrame, as_of: datetime | str) -> DataFrame:
    """Cleans, summarises and rates each article; ``error`` names the step that failed.

    A generated summary must have ten bytes or more.
    """
    cleaned = clean_articles(df)
    wants = (F.col("content") != "") & (F.col("summary") == "")
    made = summarize(cleaned.withColumn("_source", F.when(wants, F.col("content")).otherwise("")), "_source")
    made = made.withColumn("_wants", wants)
    problem = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("content cleaning failed: "), F.col("error")))
        .when(
            F.col("_wants") & F.col("summary_error").isNotNull(),
            F.concat(F.lit("summary generation failed: "), F.col("summary_error")),
        )
        .when(
            F.col("_wants") & (byte_len("generated_summary") < 10),
            "setting summary failed: summary too short (minimum 10 characters)",
        )
    )
    summary = F.when(F.col("_wants"), F.col("generated_summary")).otherwise(F.col("summary"))
    done = made.withColumns({"error": problem, "summary": summary})
    return assess_quality(done, as_of).drop("_source", "_wants", "generated_summary", "summary_error")
