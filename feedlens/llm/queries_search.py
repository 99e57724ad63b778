"""Queries for languages, ranked search and the trie of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.ball_tree import ranked_search
from feedlens.llm.language_kn import language_scores
from feedlens.llm.prefix_trie import conversation_trie


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    scores = language_scores(_read(spark, sf_dir, "documents"), remainder != 1)
    held_out = F.coalesce(remainder == 1, F.lit(False)).alias("held_out")
    return scores.select("doc_id", held_out, "lang_pred", "score", "bits", "rejected")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_read(spark, sf_dir, "conversations"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP12_SQL = rf"""WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_TERMS}, []) AS t FROM documents),
totals AS (SELECT count_if(len(t) > 0)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM texts),
counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM texts) GROUP BY r, term),
frequency AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM frequency, totals),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(coalesce({_TERMS}, [])) AS term FROM benchmark)),
sized AS (SELECT r, doc_id, 50 + (50 * len(t)::BIGINT * n_docs) // n_terms AS m FROM texts, totals WHERE len(t) > 0),
scored AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sized USING (r) GROUP BY item_id, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored JOIN sized USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""

OP13_SQL = r"""WITH codes AS (
  SELECT list(list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, n) ORDER BY n) AS code
  FROM (SELECT unnest(range(256))::BIGINT AS n)),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p,
    md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 20 AS donor, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
    lambda x, s: xor(x >> 8, code[1 + (xor(x, s) & 255)]), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns), codes),
built AS (
  SELECT convs.c, 0 AS own, p, id, words FROM convs JOIN turns ON turns.c = donor WHERE p <= h
  UNION ALL
  SELECT convs.c, 1, p, id, words FROM convs JOIN turns ON turns.c = convs.c WHERE p > h),
whole AS (SELECT c, list(id ORDER BY own, p) AS ids, list(words ORDER BY own, p) AS words FROM built GROUP BY c),
lists AS (SELECT c, coalesce(ids, []) AS ids, coalesce(words, []) AS words FROM convs LEFT JOIN whole USING (c)),
prefixes AS (
  SELECT c, d, array_to_string(ids[1:d], ',') AS k, array_to_string(ids[1:d - 1], ',') AS up, d = len(ids) AS ends,
    CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w
  FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM lists)),
nodes AS (
  SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(w) AS w, string_agg(c, ',' ORDER BY c) FILTER (WHERE ends) AS ends
  FROM prefixes GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
below AS (
  SELECT a AS d, array_to_string(ids[1:a], ',') AS k, count_if(n_children = 0) AS leaves, sum((n - 1) * w) AS saved
  FROM (SELECT known.*, ids, unnest(range(known.d + 1)) AS a FROM known JOIN lists USING (c)) GROUP BY ALL)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, y.c AS parent_conv_id, x.n::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM known x JOIN below USING (d, k) LEFT JOIN known y ON y.d = x.d - 1 AND y.k = x.up"""

QUERIES = {
    "op11_language_id": op11_language_id,
    "op12_ranked_search": op12_ranked_search,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLES = {"op12_ranked_search": OP12_SQL, "op13_conversation_trie": OP13_SQL}
