"""Training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``; run() writes each result as Parquet in the shared checkpoint
folder and reads it again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.byte_bpe import bpe_round_trip, load_ranks
from feedlens.llm.jaccard_join import ngram_jaccard_join
from feedlens.llm.mixing import mixed
from feedlens.llm.quality_qda import fit, keep_good, measured
from feedlens.llm.secrets import redact, secret_scan
from feedlens.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quadratic discriminant rejects; it learns from the labels of all documents given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(measured(docs), labels, "quality")
    return keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of similar ones; rows without an id all stay."""
    groups = ngram_jaccard_join(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets that are no widely copied examples by a mark; ``n_chars`` follows the text."""
    clean = redact(docs, secret_scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources come near their target weights."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to the same bytes."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe_round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The discriminant and the byte-pair merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
