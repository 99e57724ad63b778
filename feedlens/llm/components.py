"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.arrays import Forest
from feedlens.session import ensure_checkpoint_dir


def _condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a task by one edge from each id to the smallest id it reaches."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.union(a, b)
    ids, roots = forest.pairs()
    for at in range(0, len(ids), 100_000):
        part = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), pa.array(roots[part], pa.int64())], ["a", "b"])


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Ties the neighbours of each id (the larger ones, or the smaller ones and itself) to its smallest."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        near = near.union(edges.select("b", "a"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    moved = near.join(least, "u")
    if both:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.filter("a <> b").distinct()


def _tangled(edges: DataFrame) -> bool:
    """Whether some id points to two others, or to one that points on."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    sums = ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return bool(sums.filter("out > 1 OR (out > 0 AND into > 0)").limit(1).count())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id that has an edge and is not itself the smallest of its component.

    ``edges`` has two long columns. Each task first shrinks its edges to stars; then large and
    small stars alternate until every id points to its smallest (the rounds grow with the logarithm of the longest
    path). All grouping is by minimum, which combines before the shuffle, so a vertex with very
    many edges is no hot key. Each round is checkpointed. Null ids are ignored.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    first, second = edges.columns
    flat = edges.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a <> b")
    flat = flat.mapInArrow(_condense, "a long, b long").distinct().checkpoint()
    while _tangled(flat):
        flat = _star(_star(flat, True), False).checkpoint()
    return flat.select(F.col("a").alias("id"), F.col("b").alias("root"))
