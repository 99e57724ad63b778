"""First-wins de-duplication and union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.identity import article_hash
from feedlens.functions.text import col


def _content(df: DataFrame) -> Column:
    """A hash of all columns; maps are hashed as JSON."""
    plain = lambda f: F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name)
    parts = [F.coalesce(plain(f).cast("string"), F.lit("")) for f in df.schema if "struct<" not in f.dataType.simpleString()]
    parts += [F.to_json(f.name) for f in df.schema if "struct<" in f.dataType.simpleString()]
    return F.xxhash64(*parts)


def keep_first(df: DataFrame, key: Column | str, order: Column | str = "ingest_seq") -> DataFrame:
    """Exactly one row per key: the one with the smallest ``order``, a null order last.

    Rows of a key that share the smallest order are told apart by a hash of their content; of rows
    that are equal throughout, one stays. A null key is a key.

    The least order of a key, and how many rows have it, are hash aggregates over two columns, combined
    before the shuffle. The rows are then matched on key and order together, so the rows of a key that
    holds a third of the table are spread. Only tied rows are grouped whole, one a task before the shuffle.
    """
    marked = df.withColumns({"_dedup_key": col(key), "_dedup_order": col(order)})
    counts = marked.groupBy("_dedup_key", "_dedup_order").agg(F.count(F.lit(1)).alias("_dedup_n"))
    first = counts.groupBy("_dedup_key").agg(
        F.min_by("_dedup_n", "_dedup_order").alias("_dedup_known"),
        F.max(F.when(F.col("_dedup_order").isNull(), F.col("_dedup_n"))).alias("_dedup_null"),
        F.min("_dedup_order").alias("_dedup_order"),
    )
    first = first.select(
        F.col("_dedup_key").alias("_first_key"),
        F.col("_dedup_order").alias("_first_order"),
        F.coalesce("_dedup_known", "_dedup_null").alias("_dedup_n"),
    )
    same = F.col("_dedup_key").eqNullSafe(F.col("_first_key")) & F.col("_dedup_order").eqNullSafe(F.col("_first_order"))
    kept = marked.join(first, same)
    tied = kept.filter("_dedup_n > 1").groupBy("_dedup_key").agg(F.min_by(F.struct(*df.columns), _content(df)).alias("_dedup_row"))
    alone = kept.filter("_dedup_n = 1").select(*df.columns)
    return alone.union(tied.select("_dedup_row.*"))


def dedup_by_url(df: DataFrame, order: Column | str = "ingest_seq") -> DataFrame:
    """Key is the URL, or the id where the URL is empty."""
    return keep_first(df, F.when(F.col("url") != "", F.col("url")).otherwise(F.col("id")), order)


def dedup_articles(df: DataFrame, order: Column | str = "ingest_seq") -> DataFrame:
    """Key is the hash of folded title and URL."""
    return keep_first(df, article_hash(), order)


def dedup_repos(df: DataFrame, order: Column | str = "ingest_seq") -> DataFrame:
    """Key is the folded full name."""
    return keep_first(df, F.lower("full_name"), order)


def union_sources(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Good rows of all sources, and the failures as (source, error).

    A part may carry an ``error`` column; rows where it is set are failures.
    """
    tagged = []
    for name, df in parts.items():
        if "error" not in df.columns:
            df = df.withColumn("error", F.lit(None).cast("string"))
        tagged.append(df.withColumn("source_name", F.lit(name)))
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    good = everything.where(F.col("error").isNull()).drop("error", "source_name")
    bad = everything.where(F.col("error").isNotNull()).select(
        F.col("source_name").alias("source"),
        F.concat(F.lit("source "), F.col("source_name"), F.lit(": "), F.col("error")).alias("error"),
    )
    return good, bad


def require_some(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Raises when every source failed and none delivered a row; else returns the good rows."""
    if good.isEmpty() and not bad.isEmpty():
        raise RuntimeError("all sources failed: " + "; ".join(r.error for r in bad.limit(20).collect()))
    return good
