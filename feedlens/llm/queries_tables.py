"""Queries over vectors, pages and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.cover_tree import embedding_near_dedup
from feedlens.llm.html_density import extract_main_text
from feedlens.llm.vp_tree import nearest_neighbours


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_read(spark, sf_dir, "embeddings"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


_LIVE = """live AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
_COSINE = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"

OP3_SQL = f"""WITH RECURSIVE {_LIVE},
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM live a JOIN live b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE {_COSINE} >= 0.93),
reach(id, to_id) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a),
least AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM least LEFT JOIN counts ON a = id"""

OP5_SQL = f"""WITH {_LIVE},
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_COSINE} AS score
  FROM live a JOIN live b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

QUERIES = {
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_html_extraction": op6_html_extraction,
}
ORACLES = {"op3_embedding_near_dedup": OP3_SQL, "op5_nearest_neighbours": OP5_SQL}
