"""Corpus queries: terms, TF-IDF, keyword match, sentences, summaries and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.functions import terms
from feedlens.functions.text import plain_text
from feedlens.operators import corpus, matching, ordering, personalize, summarize
from feedlens.workload import bindings as b
from feedlens.workload import sqltext as q
from feedlens.workload.articles import LEXICON, lexicon_sql
from feedlens.workload.registry import query

WORDS = ["Tention", "the", "querying les", "aux"]


@query(
    "term_frequencies",
    b.views("articles", more=q.TERM_CTES) + "SELECT id, term, count, round(frequency, 6) AS frequency FROM tf",
)
def _tf(spark, sf_dir):
    return corpus.term_frequencies(b.articles(spark, sf_dir)).withColumn("frequency", F.round("frequency", 6))


@query(
    "top_terms",
    b.views("articles", more=q.TERM_CTES)
    + """SELECT id, row_number() OVER (PARTITION BY id ORDER BY count DESC, term) AS rank, term, count,
         round(frequency, 6) AS frequency FROM tf QUALIFY rank <= 5""",
)
def _top_terms(spark, sf_dir):
    return corpus.top_terms(b.articles(spark, sf_dir), 5).withColumn("frequency", F.round("frequency", 6))


@query(
    "stemmed_tokens",
    b.views("articles")
    + f"""SELECT t AS token, {q.stem("t")} AS stem, count(*) AS uses FROM (SELECT unnest({q.tokens("content")}) AS t FROM articles)
          GROUP BY 1, 2""",
)
def _stems(spark, sf_dir):
    return (
        b.articles(spark, sf_dir)
        .select(F.explode(terms.tokenize("content")).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("uses"))
        .select("token", terms.stem("token").alias("stem"), "uses")
    )


_STEMS = {w: terms.stem_word(terms.letters_only(w)) for w in WORDS}


def _df_sql(term: str) -> str:
    return (
        f"count(*) FILTER (WHERE contains(lower(title), '{term}') OR contains(lower(summary), '{term}') "
        f"OR contains(lower(content), '{term}') OR len(list_filter(tags, lambda t: contains(lower(t), '{term}'))) > 0)"
    )


_IDF = " UNION ALL ".join(
    f"SELECT '{s}' AS term, count(*) AS total_docs, {_df_sql(s)} AS doc_count FROM articles"
    for s in dict.fromkeys(_STEMS.values())
)
_IDF_CTE = f"""
df AS ({_IDF}),
idf AS (SELECT term, total_docs, doc_count, CASE WHEN doc_count = 0 THEN ln(total_docs) ELSE ln(total_docs * 1e0 / doc_count) END AS idf FROM df)"""


@query(
    "inverse_document_frequency",
    b.views("articles", more=_IDF_CTE) + "SELECT term, total_docs, doc_count, round(idf, 6) AS idf FROM idf",
)
def _idf(spark, sf_dir):
    rows = corpus.inverse_document_frequency(b.articles(spark, sf_dir), list(_STEMS.values()))
    return rows.withColumn("idf", F.round("idf", 6))


def vocabulary(spark, sf_dir):
    """A table of terms: the words of all benchmark items, and a weight for each."""
    words = b.read(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    words = words.where(F.length("word") > 1).distinct()
    return words.withColumn("weight", (F.length("word") % 7 + 1) / F.lit(2000.0))


_VOCABULARY = r"""
vocabulary AS (
  SELECT DISTINCT word, (length(word) % 7 + 1) / 2000e0 AS weight
  FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM benchmark) WHERE length(word) > 1)"""


@query(
    "document_frequencies",
    b.views("articles", more=_VOCABULARY)
    + """SELECT word AS term, count(*) AS total_docs, CAST(count_if(contains(lower(title), word) OR contains(lower(summary), word) OR contains(lower(content), word)
                OR list_contains(list_transform(tags, lambda t: contains(lower(t), word)), true)) AS BIGINT) AS doc_count,
           round(CASE WHEN doc_count = 0 THEN ln(total_docs) ELSE ln(total_docs * 1e0 / doc_count) END, 6) AS idf
         FROM vocabulary, articles GROUP BY word""",
)
def _frequencies(spark, sf_dir):
    rows = matching.document_frequencies(b.articles(spark, sf_dir), vocabulary(spark, sf_dir), "word")
    return rows.withColumn("idf", F.round("idf", 6))


@query(
    "lexicon_table_relevance",
    b.views("articles", more=_VOCABULARY)
    + """SELECT id, round(least(1e0, sum(weight * (CASE WHEN contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), word) THEN 1.5e0 ELSE 0e0 END + CASE WHEN contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), word) THEN 1e0 ELSE 0e0 END
           + 1.2e0 * len(list_filter(tags, lambda t: t = word))))), 6) AS relevance FROM articles, vocabulary GROUP BY id""",
)
def _lexicon_table(spark, sf_dir):
    rows = matching.lexicon_table_relevance(b.articles(spark, sf_dir), vocabulary(spark, sf_dir))
    return rows.select("id", F.round("relevance", 6).alias("relevance"))


_KEYS = ", ".join(f"('{terms.letters_only(w)}', '{s}')" for w, s in _STEMS.items())
_TFIDF_CTE = f"""{q.TERM_CTES},{_IDF_CTE},
keys(plain, stem) AS (VALUES {_KEYS}),
hits AS (
  SELECT id, plain, stem, coalesce(max(frequency) FILTER (WHERE term = plain), max(frequency)) AS f
  FROM tf JOIN keys ON term = plain OR term = stem GROUP BY 1, 2, 3
),
mean AS (SELECT id, avg(f * idf) AS m FROM hits JOIN idf ON hits.stem = idf.term GROUP BY 1),
tfidf AS (
  SELECT a.id, CASE WHEN m IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0, 2e0 / (1e0 + exp(-m)) - 1e0)) END AS tfidf
  FROM articles a LEFT JOIN mean USING (id)
)"""


@query("tfidf_score", b.views("articles", more=_TFIDF_CTE) + "SELECT id, round(tfidf, 6) AS tfidf FROM tfidf")
def _tfidf(spark, sf_dir):
    rows = b.articles(spark, sf_dir)
    return corpus.tfidf_score(rows, WORDS, rows).select("id", F.round("tfidf", 6).alias("tfidf"))


def _text_match_sql(expr: str, keyword: str) -> str:
    parts = [terms.stem_word(t) for t in terms.literal_tokens(keyword)]
    stems = f"list_transform({q.tokens(expr)}, lambda t: {q.stem('t')})"
    each = " + ".join(
        f"CASE coalesce(list_filter({stems}, lambda s: contains(s, '{p}') OR contains('{p}', s))[1], '') "
        f"WHEN '' THEN 0e0 WHEN '{p}' THEN 1e0 ELSE 0.7e0 END"
        for p in parts
    )
    return f"CASE WHEN {expr} = '' THEN 0e0 WHEN contains(lower({expr}), '{keyword}') THEN 1.5e0 ELSE ({each}) / {len(parts)} * 0.8e0 END"


def _tag_match_sql(keyword: str) -> str:
    return (
        "coalesce(list_max(list_transform(tags, lambda t: "
        f"CASE WHEN lower(trim(t)) = '{keyword}' THEN 1.5e0 WHEN contains(lower(trim(t)), '{keyword}') OR contains('{keyword}', lower(trim(t))) THEN 0.8e0 "
        f"WHEN {q.stem('lower(trim(t))')} = '{terms.stem_word(keyword)}' THEN 1.35e0 ELSE 0e0 END)), 0e0)"
    )


_MATCH_WORDS = ["the query", "Fr", "mentier"]
_MATCH = "least(1e0, (" + " + ".join(
    f"{_text_match_sql('title', k)} * 3 + {_text_match_sql('summary', k)} * 2 + {_text_match_sql('preview', k)} + {_tag_match_sql(k)} * 4"
    for k in [w.lower() for w in _MATCH_WORDS]
) + f") / {len(_MATCH_WORDS) * 4.5}e0)"
_PREVIEW = f"p AS (SELECT *, {q.head('content', 1000)} AS preview FROM articles)"


@query(
    "keyword_match_score",
    b.views("articles", more=_PREVIEW) + f"SELECT id, round({_MATCH}, 6) AS score FROM p",
)
def _match(spark, sf_dir):
    return corpus.keyword_match(b.articles(spark, sf_dir), _MATCH_WORDS).select(
        "id", F.round("keyword_score", 6).alias("score")
    )


@query(
    "relevance_score",
    b.views("articles", more=f"{_TFIDF_CTE}, {_PREVIEW}".replace(_KEYS, ", ".join(
        f"('{terms.letters_only(w)}', '{terms.stem_word(terms.letters_only(w))}')" for w in _MATCH_WORDS
    )).replace(_IDF, " UNION ALL ".join(
        f"SELECT '{s}' AS term, count(*) AS total_docs, {_df_sql(s)} AS doc_count FROM articles"
        for s in dict.fromkeys(terms.stem_word(terms.letters_only(w)) for w in _MATCH_WORDS)
    )))
    + f"SELECT id, round(least(1e0, tfidf * 0.6e0 + {_MATCH} * 0.4e0), 6) AS relevance FROM p JOIN tfidf USING (id)",
)
def _relevance(spark, sf_dir):
    rows = b.articles(spark, sf_dir)
    return corpus.relevance_score(rows, _MATCH_WORDS, rows).select("id", F.round("relevance", 6).alias("relevance"))


# --- sentences and summaries ------------------------------------------------------------

_CLEAN = f"clean AS (SELECT *, {q.tidy(q.strip('content', ''))} AS body FROM articles)"
_SENTENCES = """
parts AS (SELECT id, unnest(string_split_regex(body, '[.!?]+[\\t\\n\\f\\r ]+')) AS s, generate_subscripts(string_split_regex(body, '[.!?]+[\\t\\n\\f\\r ]+'), 1) AS i FROM clean),
sentences AS (
  SELECT id, trim(s) AS text, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS position,
         count(*) OVER (PARTITION BY id) AS n
  FROM parts WHERE strlen(trim(s)) > 10
)"""
_TRIM = ".,!?;:\"''()[]{}~"
_KEYWORDS = f"""
candidates AS (SELECT id, trim(unnest(string_split_regex(lower(body), '\\s+')), '{_TRIM}') AS w FROM clean),
keywords AS (
  SELECT id, w, count(*) AS c FROM candidates WHERE strlen(w) >= 3 AND w NOT IN ({q.SUMMARY_STOPS})
  GROUP BY 1, 2 HAVING count(*) > 1 OR strlen(w) > 6
)"""
_SCORES = """
uses AS (
  SELECT id, position, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM sentences
),
shares AS (
  SELECT u.id, u.position, count(k.w) * 1e0 / count(*) AS share
  FROM uses u LEFT JOIN keywords k ON u.id = k.id AND u.w = k.w GROUP BY 1, 2
),
scores AS (
  SELECT s.id, s.position, s.n, s.text, length(s.text) AS length,
    (1e0 - s.position * 1e0 / s.n) * 0.3e0
    + CASE WHEN length(s.text) BETWEEN 50 AND 200 THEN 1e0 WHEN length(s.text) < 20 THEN 0.2e0
           WHEN length(s.text) > 300 THEN 0.3e0 ELSE 0.7e0 END * 0.2e0
    + CASE WHEN s.id IN (SELECT id FROM keywords) THEN share ELSE 0.5e0 END * 0.5e0 AS score
  FROM sentences s JOIN shares h ON s.id = h.id AND s.position = h.position
)"""
_SCORED = b.views("articles", more=f"{_CLEAN},{_SENTENCES},{_KEYWORDS},{_SCORES}")


def _cleaned(spark, sf_dir):
    return b.articles(spark, sf_dir).withColumn("body", plain_text("content"))


@query("plain_text", b.views("articles", more=_CLEAN) + "SELECT id, md5(body) AS digest, strlen(body) AS bytes FROM clean")
def _plain(spark, sf_dir):
    return _cleaned(spark, sf_dir).select(
        "id", F.md5("body").alias("digest"), F.octet_length("body").cast("long").alias("bytes")
    )


@query(
    "extract_sentences",
    b.views("articles", more=f"{_CLEAN},{_SENTENCES}") + "SELECT id, position, text FROM sentences",
)
def _sentences(spark, sf_dir):
    rows = _cleaned(spark, sf_dir)
    return rows.select("id", F.posexplode(summarize.extract_sentences("body")).alias("position", "text")).withColumn(
        "position", F.col("position").cast("long")
    )


@query(
    "extract_keywords",
    b.views("articles", more=f"{_CLEAN},{_KEYWORDS}") + "SELECT id, w AS keyword, c AS count FROM keywords",
)
def _keywords(spark, sf_dir):
    return summarize.extract_keywords(_cleaned(spark, sf_dir), "body")


@query("score_sentences", _SCORED + "SELECT id, position, length, round(score, 10) AS score FROM scores")
def _score(spark, sf_dir):
    rows = summarize.score_sentences(_cleaned(spark, sf_dir), "body")
    return rows.select("id", "position", "length", F.round("score", 10).alias("score"))


_SUMMARY = """
best AS (
  SELECT id, n, text, position, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, position) AS r FROM scores
),
joined AS (SELECT id, string_agg(text, ' ' ORDER BY position) AS t, max(n) AS n FROM best WHERE r <= 2 GROUP BY id),
fitted AS (
  SELECT id, n, t, list_reduce(
    list_transform(string_split(t, ' '), lambda w: {'out': w, 'stop': false}),
    lambda acc, x: CASE WHEN acc.stop OR strlen(acc.out || ' ' || x.out) > 147 THEN {'out': acc.out, 'stop': true}
                        ELSE {'out': acc.out || ' ' || x.out, 'stop': false} END).out AS cut
  FROM joined
),
summaries AS (
  SELECT c.id, CASE WHEN content = '' THEN 'text cannot be empty'
                    WHEN strlen(body) >= 50 AND f.id IS NULL THEN 'no sentences found in text' ELSE '' END AS error,
    CASE WHEN content = '' THEN '' WHEN strlen(body) < 50 THEN body WHEN f.id IS NULL THEN ''
         WHEN n <= 2 OR strlen(t) <= 150 THEN t
         WHEN strlen(split_part(t, ' ', 1)) > 147 THEN '' ELSE cut || '...' END AS summary
  FROM clean c LEFT JOIN fitted f ON c.id = f.id
)"""


@query(
    "summarize",
    _SCORED.rstrip() + "," + _SUMMARY + "\nSELECT id, summary, error FROM summaries",
)
def _summaries(spark, sf_dir):
    rows = summarize.summarize(b.articles(spark, sf_dir))
    return rows.select(
        "id", F.col("generated_summary").alias("summary"), F.coalesce("summary_error", F.lit("")).alias("error")
    )


@query(
    "clean_articles",
    b.views("articles", more=f"c AS (SELECT *, {q.tidy(q.strip('title', ''))} AS t, {q.tidy(q.strip('summary', ''))} AS s, {q.tidy(q.strip('content', ''))} AS b FROM articles)")
    + """SELECT id, t AS title, s AS summary, md5(b) AS digest, array_to_string(tags, ',') AS tags,
         CASE WHEN t = '' THEN 'title cannot be empty after cleaning' ELSE '' END AS error FROM c""",
)
def _clean(spark, sf_dir):
    return summarize.clean_articles(b.articles(spark, sf_dir)).select(
        "id", "title", "summary", F.md5("content").alias("digest"), F.array_join("tags", ",").alias("tags"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


_READ = """
clean AS (SELECT *, content AS body FROM articles),""" + _SENTENCES + """,
lens AS (SELECT id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS k FROM sentences),
spread AS (SELECT id, count(*) AS n, avg(k) AS mean, stddev_pop(k) AS sd FROM lens GROUP BY 1),
parts2 AS (
  SELECT c.*, coalesce(n, 0) AS n, mean, sd, len(list_filter(string_split_regex(body, '\\s+'), lambda w: w <> '')) AS wc,
         len(list_distinct(regexp_extract_all(body, '[\\p{L}\\p{Nd}]'))) AS letters
  FROM clean c LEFT JOIN spread USING (id)
),
rated AS (
  SELECT *,
    CASE WHEN title <> '' THEN 0.3e0 ELSE 0e0 END + 0.1e0 + 0.1e0 + CASE WHEN summary <> '' THEN 0.2e0 ELSE 0e0 END
      + CASE WHEN content <> '' THEN 0.2e0 ELSE 0e0 END + CASE WHEN len(tags) > 0 THEN 0.1e0 ELSE 0e0 END AS complete,
    CASE WHEN wc = 0 OR n = 0 THEN 0e0 ELSE least(1e0,
      CASE WHEN wc * 1e0 / n BETWEEN 10 AND 25 THEN 0.4e0 ELSE 0.2e0 END + CASE WHEN letters > 20 THEN 0.3e0 ELSE 0.1e0 END
      + CASE WHEN n <= 1 THEN 0.5e0 ELSE least(1e0, sd / mean) END * 0.3e0) END AS readable,
    least(1e0, 0.5e0 + CASE WHEN len(tags) > 0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN age_hours <= 168 THEN 0.2e0 ELSE 0e0 END
      + CASE WHEN strlen(content) > 500 THEN 0.1e0 ELSE 0e0 END) AS relevant
  FROM parts2
)"""


@query(
    "assess_quality",
    b.views("articles", more=_READ)
    + """SELECT id, round(complete, 6) AS completeness, round(readable, 6) AS readability, round(relevant, 6) AS relevance,
         round(least(1e0, least(1e0, complete) * 0.4e0 + readable * 0.3e0 + relevant * 0.3e0), 6) AS quality FROM rated""",
)
def _assess(spark, sf_dir):
    rows = summarize.assess_quality(summarize.readability(b.articles(spark, sf_dir)), b.AS_OF)
    return rows.select(
        "id",
        F.round(summarize.completeness(), 6).alias("completeness"),
        F.round("readability", 6).alias("readability"),
        F.round(summarize.topical_relevance(b.AS_OF), 6).alias("relevance"),
        F.round("quality", 6).alias("quality"),
    )


_PROCESSED = _SCORED.rstrip() + "," + _SUMMARY + f""",
untagged AS (
  SELECT id, list(w ORDER BY c DESC, w)[1:5] AS words FROM (
    SELECT id, w, c FROM (
      SELECT id, w, count(*) AS c FROM (
        SELECT id, trim(unnest(string_split_regex(lower(content), '\\s+')), '{_TRIM}') AS w FROM articles)
      WHERE strlen(w) >= 3 AND w NOT IN ({q.SUMMARY_STOPS}) GROUP BY 1, 2 HAVING count(*) > 1 OR strlen(w) > 6))
  GROUP BY id
),
filled AS (
  SELECT a.id, a.title, a.content, a.source, a.published_at, a.age_hours, a.tags AS scored_tags, a.language, a.ingest_seq,
         CASE WHEN a.summary = '' THEN s.summary ELSE a.summary END AS summary,
         CASE WHEN a.language = 'de' THEN coalesce(u.words, []) ELSE a.tags END AS tags
  FROM articles a JOIN summaries s ON a.id = s.id LEFT JOIN untagged u ON a.id = u.id
),
scored AS (SELECT *, 0.5e0 AS quality, {lexicon_sql("der").replace("list_filter(tags", "list_filter(CASE WHEN language = 'de' THEN [] ELSE scored_tags END")} AS relevance FROM filled)
"""


@query(
    "process_articles",
    _PROCESSED
    + """SELECT id, summary, array_to_string(tags, ',') AS tags, round(relevance, 6) AS relevance FROM scored
         ORDER BY round(relevance * 0.4e0 + exp(-0.01e0 * age_hours) * 0.3e0 + quality * 0.2e0
           + least(1e0, quality * 0.4e0 + CASE WHEN age_hours <= 24 THEN 0.6e0 WHEN age_hours <= 168 THEN 0.4e0 * (1e0 - (age_hours - 24) / 144e0)
             WHEN age_hours <= 720 THEN 0.2e0 * (1e0 - (age_hours - 168) / 552e0) ELSE 0e0 END) * 0.1e0, 9) DESC, published_at DESC, id
         LIMIT 100""",
)
def _process(spark, sf_dir):
    rows = b.articles(spark, sf_dir)
    untagged = F.when(F.col("language") == "de", F.array().cast("array<string>")).otherwise(F.col("tags"))
    done = personalize.process_articles(
        rows.withColumn("tags", untagged), b.AS_OF, query="der", sort_by="relevance", limit=100, lexicon=LEXICON
    )
    return done.select("id", "summary", F.array_join("tags", ",").alias("tags"), F.round("relevance", 6).alias("relevance"))
