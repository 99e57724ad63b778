"""Nearest neighbours by cosine: a vantage-point tree per shard, searched by blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.arrays import runs
from feedlens.llm.vectors import cosines, matrix, prepared, scaled

_PAIRS = 1 << 15  # exact cosines at a time


class VantageTree:
    """A node splits its points at the median distance from a vantage point; leaves hold all points."""

    def __init__(self, x: np.ndarray, leaf: int = 64, seed: int = 7) -> None:
        self.x, self.points = x, scaled(x)
        self.error = 4 * (x.shape[1] + 8) * 2.0**-52  # of a dot product of unit rows
        self.slack = 4 * np.sqrt(self.error)  # of differences of distances, whose error is largest near 0
        self.leaf, self.rng = leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)))

    def _build(self, members: np.ndarray):
        if len(members) <= self.leaf:
            return members
        vantage = int(self.rng.choice(members))
        d = _distances(self.points[members], self.points[vantage][None])[:, 0]
        middle = float(np.median(d))
        inner = d <= middle
        if inner.all():  # more than half of the points are equally far
            inner = np.zeros(len(members), bool)
            inner[: len(members) // 2] = True
            parts = members[inner], members[~inner]
            return vantage, float(d[inner].max()), float(d[~inner].min()), self._build(parts[0]), self._build(parts[1])
        return vantage, middle, float(d[~inner].min()), self._build(members[inner]), self._build(members[~inner])

    def search(self, x: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, factor: float):
        """Row numbers and cosines of the ``k`` nearest points of other ids, -1 where there are fewer.

        They are ranked by exact cosine, then id, with one point per id. A side is left out when
        the triangle inequality puts it farther than the k-th best distance divided by ``factor``;
        with 1 nothing nearer can be lost.
        """
        n, queries = len(x), scaled(x)
        best = np.full((n, k), -np.inf)
        rows = np.full((n, k), -1)
        distinct, rank = np.unique(ids, return_inverse=True)
        once = len(distinct) == len(ids)
        rank = np.append(rank, len(ids))

        def exact(q: np.ndarray, p: np.ndarray, near: np.ndarray) -> np.ndarray:
            out = np.empty(len(q))
            for at in range(0, len(q), _PAIRS):
                part = slice(at, at + _PAIRS)
                with np.errstate(all="ignore"):
                    score = cosines(x[q[part]], self.x[p[part]])
                out[part] = np.where(np.isfinite(score), score, near[part])
            return out

        def leaf(members: np.ndarray, q: np.ndarray) -> None:
            dot = queries[q] @ self.points[members].T
            dot[query_ids[q][:, None] == ids[members][None, :]] = -np.inf
            least = best[q, -1]
            if once and len(members) > k:
                least = np.maximum(least, np.partition(dot, -k, axis=1)[:, -k])
            may = (dot >= least[:, None] - 2 * self.error) & (dot > -np.inf)
            use = may.any(axis=1)
            q, dot, may = q[use], dot[use], may[use]
            if not len(q):
                return
            i, j = np.nonzero(may)
            score = np.full(dot.shape, -np.inf)
            score[i, j] = exact(q[i], members[j], dot[i, j])
            all_s = np.concatenate([best[q], score], axis=1)
            all_r = np.concatenate([rows[q], np.broadcast_to(members, score.shape)], axis=1)
            if not once:  # of one id only its best point
                order = np.lexsort((-all_s, rank[all_r]), axis=-1)
                all_s, all_r = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_r, order, 1)
                all_s[:, 1:][rank[all_r[:, 1:]] == rank[all_r[:, :-1]]] = -np.inf
            order = np.lexsort((rank[all_r], -all_s), axis=-1)[:, :k]
            best[q] = np.take_along_axis(all_s, order, 1)
            rows[q] = np.where(np.isinf(best[q]), -1, np.take_along_axis(all_r, order, 1))

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if not isinstance(node, tuple):
                leaf(node, q)
                return
            vantage, inside, outside, inner, outer = node
            d = _distances(queries[q], self.points[vantage][None])[:, 0]
            near = d <= (inside + outside) / 2
            visit(inner, q[near])
            visit(outer, q[~near])
            reach = np.sqrt(np.maximum(0, 2 - 2 * best[q, -1])) / factor + self.slack
            visit(outer, q[near & (outside - d <= reach)])
            visit(inner, q[~near & (d - inside <= reach)])

        if len(self.points):
            visit(self.root, np.arange(n))
        return rows, best


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def _search(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["dim", "shard", "block"]):
            asks, x, ids = t["asks"].to_numpy(zero_copy_only=False), matrix(t["v"]), t["id"].to_numpy()
            have, want = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(have) or not len(want):
                continue
            rows, scores = VantageTree(x[have]).search(x[want], ids[want], ids[have], k, factor)
            q, j = np.nonzero(rows >= 0)
            found, score = have[rows[q, j]], scores[q, j]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[want][q], pa.int64()), pa.array(ids[found], pa.int64()), pa.array(score)],
                ["query_id", "vec_id", "score"],
            )

    return run


def nearest_neighbours(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    factor: float = 1.0,
    shard_rows: int = 4096,
    query_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine for each query row.

    ``is_query`` is a condition on the table's columns. All rows are indexed, each in one shard of
    about ``shard_rows``; blocks of ``query_rows`` queries visit every shard. Of equal vectors the k + 1 smallest ids are indexed, which
    is all that can be among the k nearest. ``factor`` >= 1
    relaxes the pruning: 1 is exact, larger values search less. Ties go to the smaller id. Vectors
    that are null, all zero or hold a null or non-finite component take no part, nor do rows
    without an id; vectors of different lengths are not compared. A row is no neighbour of its
    own id; equal ids with different vectors are ranked once, by the better one. Fewer candidates
    give fewer rows, an empty table none. Other columns are ignored.
    """
    if factor < 1:
        raise ValueError("factor must be at least 1")
    asked = prepared(df.filter(is_query), id_col, vector_col).distinct()
    rows = prepared(df, id_col, vector_col).distinct()
    copies = Window.partitionBy("v").orderBy("id")  # equal vectors tie: k others of the smallest ids are enough
    rows = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    n, most = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-most // query_rows))
    place = F.xxhash64("id", "v")
    index = rows.select(
        "dim", F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "id", "v",
    )
    asks = asked.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(place, F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), "id", "v",
    )
    keys = ["dim", "shard", "block"]
    dealt = index.union(asks).repartition(*keys).sortWithinPartitions(*keys, "asks", "id")
    found = dealt.mapInArrow(_search(k, factor), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
