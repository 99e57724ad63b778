"""Exact near-duplicate vectors by dual traversal of cover trees.

The vectors of a label are dealt to shards of bounded size, and each pair of shards is one
step of a task: both get a cover tree (nested centres, radii halving from level to level), and
node pairs whose balls lie farther apart than the threshold are dropped together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.arrays import runs
from feedlens.llm.components import components
from feedlens.llm.vectors import cosines, matrix, scaled, usable
from feedlens.session import ensure_checkpoint_dir

_SLACK = 1e-9


class CoverTree:
    """Nodes in arrays. The points below a node are ``order[start:end]``; ``radius`` is the
    largest distance of the centre to them, at most that of the node's level."""

    def __init__(self, points: np.ndarray, smallest: float, leaf: int = 8) -> None:
        self.points = points
        self.order = np.arange(len(points))
        self.centre, self.start, self.end, self.radius, self.children = [], [], [], [], []
        self._add(0, 0, len(points), 2.0, smallest, leaf)

    def _distance(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.points[members] @ self.points[centre])))

    def _add(self, centre: int, start: int, end: int, level: float, smallest: float, leaf: int) -> int:
        me, members = len(self.centre), self.order[start:end].copy()
        far = self._distance(centre, members)
        self.centre.append(centre), self.start.append(start), self.end.append(end)
        self.radius.append(float(far.max())), self.children.append([])
        level = min(level, 2 * self.radius[me])
        if end - start <= leaf or level <= smallest:
            return me
        step, left, at = level / 2, members, start
        pieces: list[tuple[int, int, int]] = []
        c = centre  # a centre stays a centre on the next level
        while len(left):
            near = (far if c == centre else self._distance(c, left)) <= step
            own = left[near]
            self.order[at : at + len(own)] = own
            pieces.append((c, at, at + len(own)))
            at += len(own)
            left = left[~near]
            c = int(left[0]) if len(left) else -1
        for c, a, b in pieces:
            self.children[me].append(self._add(c, a, b, step, smallest, leaf))
        return me


def close_pairs(left: CoverTree, right: CoverTree, reach: float, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of point sets (of left, of right) that hold every pair within ``reach``."""
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        small = (left.end[p] - left.start[p]) * (right.end[q] - right.start[q]) <= block
        if small or not (left.children[p] or right.children[q]) or left.radius[p] + right.radius[q] < reach / 2:
            yield left.order[left.start[p] : left.end[p]], right.order[right.start[q] : right.end[q]]
            continue
        ps = np.array(left.children[p] if left.children[p] and (left.radius[p] * 2 >= right.radius[q] or not right.children[q]) else [p])
        qs = np.array(right.children[q] if right.children[q] and (right.radius[q] * 2 >= left.radius[p] or not left.children[p]) else [q])
        dots = left.points[np.array(left.centre)[ps]] @ right.points[np.array(right.centre)[qs]].T
        apart = np.sqrt(np.maximum(0, 2 - 2 * dots))
        cover = np.array(left.radius)[ps][:, None] + np.array(right.radius)[qs][None, :]
        i, j = np.nonzero(apart - cover <= reach)
        stack.extend(zip(ps[i].tolist(), qs[j].tolist(), strict=True))


def _linked(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of row numbers (a of x, b of y) reach ``least``; close calls by exact order of addition."""
    return cosines(x[a], y[b]) >= least


def _count_links(least: float):
    smallest = np.sqrt(2 - 2 * least) / 4

    def of_pair(t: pa.Table):
        ids, shard, x = t["id"].to_numpy(), t["shard"].to_numpy(), matrix(t["v"])
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        unit = scaled(x)
        rows = [np.flatnonzero(shard == i), np.flatnonzero(shard == j)]
        if not len(rows[0]) or not len(rows[1]):
            return None
        trees = [CoverTree(unit[r], smallest) for r in (rows if i != j else rows[:1])]
        count, label = np.zeros(len(ids), np.int64), np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        reach = np.sqrt(2 - 2 * least) + _SLACK
        for a, b in close_pairs(trees[0], trees[-1], reach):
            for at in range(0, len(a), max(1, 1_000_000 // len(b))):
                ra, rb = rows[0][a[at : at + max(1, 1_000_000 // len(b))]], rows[1][b]
                dots = unit[ra] @ unit[rb].T
                k, m = np.nonzero(dots >= least - _SLACK)
                k, m = ra[k], rb[m]
                other = ids[k] != ids[m]
                k, m = k[other], m[other]
                sure = unit[k].shape[0] == 0
                if not sure:
                    near = np.abs((unit[k] * unit[m]).sum(axis=1) - least) <= _SLACK
                    fine = np.ones(len(k), bool)
                    fine[near] = _linked(k[near], m[near], x, x, least)
                    k, m = k[fine], m[fine]
                np.add.at(count, k, 1)
                if i != j:
                    np.add.at(count, m, 1)
                while True:  # smallest label over the block's links
                    before = label.copy()
                    np.minimum.at(label, k, label[m])
                    np.minimum.at(label, m, label[k])
                    if (label == before).all():
                        break
        by_rank = np.sort(ids)
        return ids, count, by_rank[label]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["label", "dim", "i", "j"]):
            if found := of_pair(t):
                ids, count, root = found
                some = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(c[some], pa.int64()) for c in (ids, count, root)], ["id", "n", "root"])

    return run


def embedding_near_dedup(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.93,
    shard_rows: int = 1024,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Rows link when their labels are equal and not null, their vectors have one length and their
    cosine in doubles is at least ``least`` (above 0, below 1). Vectors that are null, all zero or
    hold a null or non-finite component link with nothing, so do rows without an id (their
    component is null, ``kept`` false). Equal rows count once; different vectors of one id are
    one vector with the links of all. An empty table gives no rows; other columns are ignored.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.col(label_col).cast("string").alias("label"),
    )
    live = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    live = live.distinct().withColumn("dim", F.size("v"))
    shards = live.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = live.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("id", "v"), "shards").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    paired = dealt.withColumn("other", other).select(
        "label", "dim", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "shard", "id", "v"
    )
    keys = ["label", "dim", "i", "j"]
    counted = paired.repartition(*keys).sortWithinPartitions(*keys, "shard", "id")
    counted = counted.mapInArrow(_count_links(least), "id long, n long, root long").checkpoint()
    links = counted.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(counted.select("id", "root"))
    ids = rows.select("id")
    out = ids.join(links, "id", "left").join(roots, "id", "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
