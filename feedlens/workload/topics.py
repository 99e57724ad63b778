"""Topic search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.functions import topic
from feedlens.operators import conform, filters, reports
from feedlens.operators.conversations import with_relevance
from feedlens.plans.topic import topic_search
from feedlens.workload import bindings as b
from feedlens.workload.registry import query

TEXT = "ention the javascript"

# Technology weights for the given documents, whose words are invented.
TECH = {"the": 0.9, "ention": 1.0, "javascript": 0.8}


def text_sql(body: str, keywords: list[str]) -> str:
    score, hits = [], []
    for k in keywords:
        half = len(k) // 2
        score.append(
            f"CASE WHEN NOT contains({body}, '{k}') THEN 0e0 WHEN starts_with({body}, '{k}') THEN 1e0 "
            f"WHEN strlen(left({body}, strpos({body}, '{k}') - 1 + {len(k)})) <= 100 THEN 0.8e0 ELSE 0.6e0 END"
        )
        if len(k) > 4:
            score.append(
                f"CASE WHEN contains({body}, '{k[:half]}') OR contains({body}, '{k[half:]}') THEN 0.3e0 ELSE 0e0 END"
            )
        hits.append(f"CASE WHEN contains({body}, '{k}') THEN 1 ELSE 0 END")
    n = f"{len(keywords)}e0"
    return f"greatest(0.1e0, least(1e0, ({' + '.join(score)}) / {n} + ({' + '.join(hits)}) / {n} * 0.2e0))"


def tag_sql(keywords: list[str]) -> str:
    parts = [
        f"CASE WHEN lower(t) = '{k}' THEN 1e0 WHEN contains(lower(t), '{k}') THEN 0.7e0 "
        f"WHEN contains('{k}', lower(t)) THEN 0.5e0 ELSE 0e0 END"
        for k in keywords
    ]
    return f"least(1e0, list_sum(list_transform(tags, lambda t: {' + '.join(parts)})) / {len(keywords)}e0)"


def tech_sql(body: str, text: str, table: dict[str, float]) -> str:
    parts = [f"CASE WHEN contains({body}, '{w}') THEN {x!r}e0 ELSE 0e0 END" for w, x in table.items() if w in text]
    return "greatest(0e0, " + ", ".join(parts) + ")" if parts else "0e0"


def clamp(expr: str) -> str:
    return f"greatest(0.1e0, least(1e0, {expr}))"


_WORDS = TEXT.split()
_A_BODY = "lower(title || ' ' || summary)"
_R_BODY = "lower(name || ' ' || description)"
_D_BODY = "lower(title || ' ' || content)"
ARTICLE = clamp(f"{text_sql(_A_BODY, _WORDS)} * 0.5e0 + {tag_sql(_WORDS)} * 0.3e0 + {tech_sql(_A_BODY, TEXT, TECH)} * 0.2e0")
LANGUAGE = "CASE WHEN lower(language) <> '' AND contains('ention the javascript', lower(language)) THEN 1e0 ELSE 0e0 END"
POPULARITY = "CASE WHEN stars <= 0 THEN 0e0 ELSE greatest(0e0, least(1e0, log10(stars) / 3e0 * 0.5e0)) END"
REPO = clamp(f"{text_sql(_R_BODY, _WORDS)} * 0.6e0 + {LANGUAGE} * 0.3e0 + {POPULARITY} * 0.1e0")
TALK = text_sql(_D_BODY, _WORDS)


def _search(spark, sf_dir, text=TEXT, **settings):
    return topic_search(
        conform.to_articles(b.articles(spark, sf_dir), b.AS_OF), b.repositories(spark, sf_dir),
        b.discussions(spark, sf_dir), text, b.AS_OF, tech_weights=TECH, turns=b.turns(spark, sf_dir), **settings,
    )


def _all_rows(result):
    a, r, d = (result.rows[n] for n in ("articles", "repositories", "discussions"))
    return (
        a.select(F.lit("article").alias("kind"), "ingest_seq", F.round("relevance", 6).alias("score"))
        .unionByName(r.select(F.lit("repository").alias("kind"), "ingest_seq", F.round("trend_score", 6).alias("score")))
        .unionByName(d.select(F.lit("discussion").alias("kind"), "ingest_seq", F.round("relevance", 6).alias("score")))
    )


def _ctes(min_score: str, keys: tuple[str, str, str], quota: tuple[int, int, int]) -> str:
    return f"""
a AS (SELECT *, {ARTICLE} AS score, {b.QUALITY_SQL} AS quality FROM articles),
r AS (SELECT *, {REPO} AS score FROM repositories),
d AS (SELECT * RENAME (score AS votes), {TALK} AS score FROM discussions),
top_a AS (SELECT * FROM a WHERE score >= {min_score} ORDER BY {keys[0]} LIMIT {quota[0]}),
top_r AS (SELECT * FROM r WHERE score >= {min_score} ORDER BY {keys[1]} LIMIT {quota[1]}),
top_d AS (SELECT * FROM d WHERE score >= {min_score} ORDER BY {keys[2]} LIMIT {quota[2]})"""


_RANK = "round(score, 9) DESC, id, ingest_seq"
SEARCH = b.views("articles", "repositories", "discussions", more=_ctes("0.15e0", (_RANK, _RANK, _RANK), (10, 10, 10)))
_UNION = """SELECT 'article' AS kind, ingest_seq, round(score, 6) AS score FROM top_a
  UNION ALL SELECT 'repository', ingest_seq, round(score, 6) FROM top_r
  UNION ALL SELECT 'discussion', ingest_seq, round(score, 6) FROM top_d"""


@query("topic_search", SEARCH + _UNION)
def _default(spark, sf_dir):
    return _all_rows(_search(spark, sf_dir))


@query(
    "topic_search_by_date",
    b.views(
        "articles", "repositories", "discussions",
        more=_ctes(
            "0.3e0",
            ("published_at DESC, id, ingest_seq", "updated_at DESC, id, ingest_seq", "created_at DESC, id, ingest_seq"),
            (33, 33, 34),
        ),
    )
    + _UNION,
)
def _by_date(spark, sf_dir):
    return _all_rows(_search(spark, sf_dir, sort_by="date", min_score=0.3, max_results=100))


@query(
    "topic_search_by_stars",
    b.views(
        "articles", "repositories", "discussions",
        more=_ctes("0.3e0", ("ingest_seq", "stars DESC, id, ingest_seq", "votes DESC, id, ingest_seq"), (16, 16, 18)),
    )
    + _UNION,
)
def _by_stars(spark, sf_dir):
    return _all_rows(_search(spark, sf_dir, sort_by="stars", min_score=0.3, max_results=50))


@query(
    "topic_search_repositories_only",
    b.views("repositories", more=f"r AS (SELECT *, {REPO} AS score FROM repositories)")
    + f"SELECT 'repository' AS kind, ingest_seq, round(score, 6) AS score FROM r WHERE score >= 0.5e0 ORDER BY {_RANK} LIMIT 33",
)
def _repos_only(spark, sf_dir):
    return _all_rows(
        _search(spark, sf_dir, platform="github", search_type="repositories", min_score=0.5, max_results=100)
    )


@query(
    "search_summary",
    SEARCH
    + """, s AS (SELECT score FROM top_a UNION ALL SELECT score FROM top_r UNION ALL SELECT score FROM top_d)
       SELECT (SELECT count(*) FROM top_a) AS articles, (SELECT count(*) FROM top_r) AS repositories,
              (SELECT count(*) FROM top_d) AS discussions, (SELECT count(*) FROM s) AS total_results,
              (SELECT round(avg(score), 6) FROM s) AS average_score""",
)
def _summary(spark, sf_dir):
    return _search(spark, sf_dir).reports["summary"].withColumn("average_score", F.round("average_score", 6))


@query(
    "search_keywords",
    SEARCH
    + """SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM top_a) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def _keywords(spark, sf_dir):
    return _search(spark, sf_dir).reports["keywords"]


@query(
    "platform_info",
    b.views("articles", "discussions", more=f"a AS (SELECT *, {b.QUALITY_SQL} AS quality FROM articles), d AS (SELECT *, {TALK} AS q FROM discussions)")
    + """SELECT name, 'mixed' AS type, count(*) AS count, round(avg(quality), 6) AS quality FROM (
           SELECT source AS name, quality FROM a UNION ALL SELECT platform, q FROM d) GROUP BY 1""",
)
def _platforms(spark, sf_dir):
    articles = conform.to_articles(b.articles(spark, sf_dir), b.AS_OF)
    talks = with_relevance(b.discussions(spark, sf_dir), b.turns(spark, sf_dir), TEXT)
    return reports.platform_info(articles, talks).withColumn("quality", F.round("quality", 6))


# --- the parts of the score -------------------------------------------------------------


@query(
    "topic_article_scores",
    b.views("articles")
    + f"""SELECT id, round({text_sql(_A_BODY, _WORDS)}, 6) AS text, round({tag_sql(["fr", "curated", "e"])}, 6) AS tag,
          round({tech_sql(_A_BODY, TEXT, TECH)}, 6) AS tech, round({ARTICLE}, 6) AS score FROM articles""",
)
def _article_scores(spark, sf_dir):
    body = F.concat_ws(" ", "title", "summary")
    return b.articles(spark, sf_dir).select(
        "id",
        F.round(topic.text_relevance(body, topic.query_keywords(TEXT)), 6).alias("text"),
        F.round(topic.tag_relevance("tags", ["fr", "curated", "e"]), 6).alias("tag"),
        F.round(topic.tech_relevance(body, TEXT, TECH), 6).alias("tech"),
        F.round(topic.article_topic_relevance(TEXT, TECH), 6).alias("score"),
    )


@query(
    "topic_repo_scores",
    b.views("repositories")
    + f"""SELECT ingest_seq, round({text_sql(_R_BODY, ["react", "cli"])}, 6) AS text,
          CASE WHEN language = '' THEN 0e0 WHEN language = 'TypeScript' THEN 1e0 WHEN language = 'Python' THEN 0.9e0 WHEN language = 'Go' THEN 1e0
               ELSE 0e0 END AS language,
          round({POPULARITY}, 6) AS popularity, round({REPO}, 6) AS score FROM repositories""",
)
def _repo_scores(spark, sf_dir):
    return b.repositories(spark, sf_dir).select(
        "ingest_seq",
        F.round(topic.text_relevance(F.concat_ws(" ", "name", "description"), ["react", "cli"]), 6).alias("text"),
        topic.language_relevance("language", "TypeScript or GOLAN for PY").alias("language"),
        F.round(topic.popularity_score(), 6).alias("popularity"),
        F.round(topic.repo_topic_relevance(TEXT), 6).alias("score"),
    )


@query(
    "topic_discussion_scores",
    b.views("discussions") + f"SELECT id, platform, score, replies, round({TALK}, 6) AS relevance FROM discussions",
)
def _talk_scores(spark, sf_dir):
    scored = with_relevance(b.discussions(spark, sf_dir), b.turns(spark, sf_dir), TEXT)
    return scored.select("id", "platform", "score", "replies", F.round("relevance", 6).alias("relevance"))


@query(
    "filter_min_score",
    b.views("discussions") + f"SELECT id FROM discussions WHERE {TALK} >= 0.5e0",
)
def _min_score(spark, sf_dir):
    scored = with_relevance(b.discussions(spark, sf_dir), b.turns(spark, sf_dir), TEXT)
    return filters.filter_min_score(scored, 0.5).select("id")
