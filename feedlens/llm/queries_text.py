"""Queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import secrets
from feedlens.llm.byte_bpe import bpe_round_trip, load_ranks
from feedlens.llm.context_tree import context_tree_scores
from feedlens.llm.jaccard_join import ngram_jaccard_join
from feedlens.llm.mixing import mixed_sizes
from feedlens.llm.quality_qda import quality_scores
from feedlens.llm.secrets import secret_scan, spans_text
from feedlens.llm.toxicity import toxicity_scores


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_documents(spark, sf_dir))


OP1_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE [] END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach(id, to_id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a),
least AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM least LEFT JOIN sizes ON doc_id = id"""


#: per span of ``spans``, comma-joined: in how many rows, repositories and owners its value occurs, and the verdict
_SPREAD = ["documents", "repositories", "owners", "verdict"]


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = secret_scan(_documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan.select(
        "doc_id",
        *[count(kind[0]) for kind in secrets.BASE],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
        *[F.array_join(F.col(f"found.{name}").cast("array<string>"), ",").alias(name) for name in _SPREAD],
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _span_sql(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind in DuckDB: positions from the pieces between the matches."""
    p, k = _sql_text(pattern), secrets.KINDS.index(kind)
    return f"""SELECT doc_id, {k} AS k, i, v[i] AS value,
    list_sum(list_transform(pieces[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS s, length(whole[i]) AS n
  FROM (SELECT doc_id, unnest(range(1, len(whole) + 1)) AS i, whole, v, pieces FROM (
    SELECT doc_id, regexp_extract_all(t, {p}) AS whole, regexp_extract_all(t, {p}, {group}) AS v,
      string_split_regex(t, {p}) AS pieces FROM texts WHERE regexp_matches(t, {p})))
  WHERE length(v[i]) >= {least}"""


_NAMES = "['assign', 'access', 'hex', 'opaque'][k + 1]"
OP2_SQL = f"""WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner,
    coalesce(lang, chr(0)) AS lang FROM documents),
base AS (
  {"\n  UNION ALL\n  ".join(_span_sql(*kind) for kind in secrets.BASE)}),
opaque AS (
  SELECT * FROM ({_span_sql("opaque", secrets.OPAQUE, 0, 32)})
  WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')),
clear AS (
  SELECT * FROM opaque o WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.s < o.s + o.n AND o.s < b.s + b.n)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM clear),
counted AS (
  SELECT value, count(DISTINCT doc_id) AS d, count(DISTINCT (owner, lang)) AS r, count(DISTINCT owner) AS c
  FROM every JOIN texts USING (doc_id) GROUP BY value),
judged AS (
  SELECT *, CASE WHEN c >= 3 OR (c > 1 AND r >= 6) THEN 'example' WHEN c = 1 THEN 'live' ELSE 'shared' END AS verdict FROM counted),
found AS (
  SELECT doc_id, string_agg({_NAMES} || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans,
    string_agg(d, ',' ORDER BY s, k) AS documents, string_agg(r, ',' ORDER BY s, k) AS repositories,
    string_agg(c, ',' ORDER BY s, k) AS owners, string_agg(verdict, ',' ORDER BY s, k) AS verdict
  FROM every JOIN judged USING (value) WHERE k < 3 OR verdict = 'live' GROUP BY doc_id),
told AS (
  SELECT doc_id, count_if(k = 0) AS a, count_if(k = 1) AS b, count_if(k = 2) AS c,
    string_agg({_NAMES} || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans
  FROM base GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(told.spans, '')) AS base_sha256, coalesce(found.spans, '') AS spans,
  coalesce(documents, '') AS documents, coalesce(repositories, '') AS repositories, coalesce(owners, '') AS owners,
  coalesce(verdict, '') AS verdict
FROM texts LEFT JOIN told USING (doc_id) LEFT JOIN found USING (doc_id)"""


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(_documents(spark, sf_dir))


OP8_SQL = r"""WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('0:' || doc_id), 1, 15))::BIGINT AS u FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
filling AS (
  SELECT *, 3 * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE AS lft,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS share
  FROM sources WINDOW before AS (
    ORDER BY 3 * source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, max(CASE WHEN lft / share * w < cap THEN lft / share END) OVER () AS lvl FROM filling),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(w * lvl, cap::DOUBLE)) AS target FROM levels),
plan AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM targets),
ordered AS (
  SELECT doc_id, size, s.source, source_size, target, whole, target - whole * source_size AS need,
    sum(size) OVER (PARTITION BY s.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + (need > 0 AND upto - size / 2 <= need)::BIGINT))::BIGINT AS taken FROM ordered"""


def _remainder(mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col("doc_id").cast("string")) % mod


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(_documents(spark, sf_dir), _labels(spark, sf_dir).filter(_remainder(5) != 0))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    return scores.select("doc_id", held_out, "score", "predicted")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(_documents(spark, sf_dir), _labels(spark, sf_dir).filter(_remainder(3) != 1))
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")
    return scores.select("doc_id", held_out, "score", "predicted")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe_round_trip(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = context_tree_scores(_documents(spark, sf_dir), _remainder(10) != 0)
    held_out = F.coalesce(_remainder(10) == 0, F.lit(False)).alias("held_out")
    return scores.select(
        "doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secret_scan": op2_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_mix_sources": op8_mix_sources,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_context_tree": op10_context_tree,
}
ORACLES = {"op1_ngram_jaccard_join": OP1_SQL, "op2_secret_scan": OP2_SQL, "op8_mix_sources": OP8_SQL}
