"""Term statistics and TF-IDF relevance over a corpus of articles.

An article is the unit of grouping: one shuffle of texts by id serves term counts, totals and ranks.
Document frequencies are asked for a short list of terms and need one aggregate pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.arrays import empty_strings, pin
from feedlens.functions.scores import unit
from feedlens.functions.terms import (
    MatchWeights,
    letters_only,
    stem,
    stem_word,
    tag_match,
    text_match,
    tokenize,
)
from feedlens.functions.text import byte_len, cut_bytes
from feedlens.operators.tally import COUNTS, by_document, in_id_order, read_terms, spaced


FIELD_WEIGHTS = {"title": 3, "summary": 2, "content": 1}
TAG_WEIGHT = 4


def _term_counts(articles: DataFrame) -> DataFrame:
    """(id, words, total): the terms of each article with their weighted uses and the sum of these.

    Each field is split once and its words carry the field's weight.
    """
    tags = F.array_join(F.coalesce("tags", empty_strings()), " ")
    weights = [(w, F.col(c)) for c, w in FIELD_WEIGHTS.items()] + [(TAG_WEIGHT, tags)]
    fields = [F.struct(F.lit(w).alias("w"), spaced(t, r"[^\p{L}]+").alias("t")) for w, t in weights]
    placed = in_id_order(articles.select("id", "title", "summary", "content", "tags"))
    counted = by_document(placed, F.array(*fields), read_terms, f"words {COUNTS}")
    total = F.aggregate("words", F.lit(0).cast("long"), lambda acc, t: acc + t["n"])
    return counted.select("id", "words", total.alias("total"))


def term_frequencies(articles: DataFrame) -> DataFrame:
    """(id, term, count, frequency) of the stemmed terms of each article."""
    rows = _term_counts(articles).select("id", "total", F.inline("words").alias("term", "count"))
    return rows.select("id", "term", "count", (F.col("count") / F.col("total")).alias("frequency"))


def top_terms(articles: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent terms of each article, ties in term order."""
    order = F.transform("words", lambda t: F.struct((-t["n"]).alias("uses"), t["word"].alias("term")))
    best = _term_counts(articles).select("id", "total", F.slice(F.sort_array(order), 1, n).alias("best"))
    count = -F.col("t.uses")
    return best.select("id", "total", F.posexplode("best").alias("place", "t")).select(
        "id", (F.col("place") + 1).cast("long").alias("rank"), "t.term", count.alias("count"),
        (count / F.col("total")).alias("frequency"),
    )


def _holds(term: str) -> Column:
    """The term occurs in a field. A token whose stem equals the term starts with it, so the
    substring test covers stemmed matches too."""
    needle = F.lit(term)
    out = F.exists(F.coalesce(F.col("tags"), empty_strings()), lambda t: F.contains(F.lower(t), needle))
    for field in ("title", "summary", "content"):
        out = out | ((F.col(field) != "") & F.contains(F.lower(field), needle))
    return out


def idf_value(total: Column, frequency: Column) -> Column:
    return (
        F.when(total == 0, F.lit(0.0))
        .when(frequency == 0, F.ln(total.cast("double")))
        .otherwise(F.ln(total.cast("double") / frequency))
    )


def inverse_document_frequency(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """(term, total_docs, doc_count, idf) of a short list of terms, in one pass."""
    terms = list(dict.fromkeys(terms))
    counts = corpus.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(_holds(term)).alias(f"df{i}") for i, term in enumerate(terms)],
    )
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"df{i}").alias("df")) for i, t in enumerate(terms)])
    return counts.select("n", F.explode(rows).alias("r")).select(
        F.col("r.term").alias("term"),
        F.col("n").alias("total_docs"),
        F.col("r.df").alias("doc_count"),
        idf_value(F.col("n"), F.col("r.df")).alias("idf"),
    )


def _keyword_frequencies(articles: DataFrame, terms: list[str]) -> DataFrame:
    """Adds ``_tf0``, ``_tf1``, ...: the frequency of each term among the article's terms, NULL
    where it does not occur. The words of a row are stemmed once; no row leaves its place."""
    tags = F.array_join(F.coalesce("tags", empty_strings()), " ")
    fields = {f"_w_{c}": (w, F.col(c)) for c, w in FIELD_WEIGHTS.items()} | {"_w_tags": (TAG_WEIGHT, tags)}

    def kept(text: Column) -> Column:
        stems = F.transform(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: stem(t))
        counts = F.filter(stems, lambda t: (byte_len(t) > 2) & ~t.isin(vocab.TERM_STOP_WORDS))
        return F.coalesce(counts, empty_strings())

    split = pin(articles, **{name: kept(text) for name, (_, text) in fields.items()})
    total = sum((F.size(name) * w for name, (w, _) in fields.items()), F.lit(0))
    out = {}
    for i, term in enumerate(terms):
        uses = sum((F.size(F.filter(name, lambda t: t == term)) * w for name, (w, _) in fields.items()), F.lit(0))
        out[f"_tf{i}"] = F.when(uses > 0, uses / total)
    return split.withColumns(out).drop(*fields)


def tfidf_score(
    articles: DataFrame,
    keywords: list[str],
    corpus: DataFrame,
    weights: MatchWeights = MatchWeights(),
    match: str | None = None,
) -> DataFrame:
    """Adds ``tfidf``: the squashed mean of tf x idf over the keywords that occur.

    With an empty corpus it is half the keyword match score, taken from the column ``match`` if
    it is there already.
    """
    if not keywords:
        return articles.withColumn("tfidf", F.lit(0.0))
    variants = [(letters_only(k), stem_word(letters_only(k))) for k in keywords]
    idf_of = {s: f"s{i}" for i, s in enumerate(dict.fromkeys(v[1] for v in variants))}
    total = F.count(F.lit(1))
    statistics = corpus.agg(
        F.struct(
            total.alias("n"),
            *[idf_value(total, F.count_if(_holds(s))).alias(name) for s, name in idf_of.items()],
        )
    ).scalar()
    found = list(dict.fromkeys(v for pair in variants for v in pair))
    staged = _keyword_frequencies(articles, found).withColumn("_corpus", statistics)
    score, matched = F.lit(0.0), F.lit(0)
    for plain, stemmed in variants:
        tf = F.coalesce(F.col(f"_tf{found.index(plain)}"), F.col(f"_tf{found.index(stemmed)}"))
        score = score + F.coalesce(tf, F.lit(0.0)) * F.col(f"_corpus.{idf_of[stemmed]}")
        matched = matched + tf.isNotNull().cast("int")
    mean = score / matched
    squashed = F.when(matched == 0, F.lit(0.0)).otherwise(unit(F.lit(2.0) / (F.lit(1.0) + F.exp(-mean)) - 1))
    by_word = staged if match else keyword_match(staged, keywords, weights, "_match")
    fallback = F.col(match or "_match") * F.lit(0.5)
    return by_word.withColumn("tfidf", F.when(F.col("_corpus.n") == 0, fallback).otherwise(squashed)).drop(
        "_corpus", "_match", *[f"_tf{i}" for i in range(len(found))]
    )


def relevance_score(
    articles: DataFrame, keywords: list[str], corpus: DataFrame, weights: MatchWeights = MatchWeights()
) -> DataFrame:
    """Sets ``relevance`` to 0.6 TF-IDF + 0.4 keyword match; 0 without keywords."""
    if not keywords:
        return articles.withColumn("relevance", F.lit(0.0))
    matched = keyword_match(articles, keywords, weights, "_keyword")
    scored = tfidf_score(matched, keywords, corpus, weights, "_keyword")
    mixed = F.col("tfidf") * F.lit(0.6) + F.col("_keyword") * F.lit(0.4)
    return scored.withColumn("relevance", unit(mixed)).drop("tfidf", "_keyword")


def keyword_match(
    articles: DataFrame, keywords: list[str], weights: MatchWeights = MatchWeights(), out: str = "keyword_score"
) -> DataFrame:
    """Adds the weighted keyword match over title, summary, the first 1000 content bytes and tags.

    Each field is folded and stemmed once for all keywords.
    """
    best = len(keywords) * weights.title * weights.exact
    if best == 0:
        return articles.withColumn(out, F.lit(0.0))
    folded = pin(
        articles,
        _title=F.lower("title"),
        _summary=F.lower("summary"),
        _preview=F.lower(cut_bytes("content", 1000)),
    )
    stemmed = pin(
        folded, **{f"{f}_stems": F.transform(tokenize(f), lambda t: stem(t)) for f in ("_title", "_summary", "_preview")}
    )
    total: Column = F.lit(0.0)
    for raw in keywords:
        keyword = raw.strip().lower()
        total = (
            total
            + text_match("_title", "_title_stems", keyword, weights) * F.lit(weights.title)
            + text_match("_summary", "_summary_stems", keyword, weights) * F.lit(weights.summary)
            + text_match("_preview", "_preview_stems", keyword, weights) * F.lit(weights.content)
            + tag_match("tags", keyword, weights) * F.lit(weights.tag)
        )
    return stemmed.withColumn(out, F.least(total / F.lit(best), F.lit(1.0))).drop(
        "_title", "_summary", "_preview", "_title_stems", "_summary_stems", "_preview_stems"
    )
