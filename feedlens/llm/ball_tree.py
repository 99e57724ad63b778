"""Ranked lexical search: exact inner products over ball trees of sparse documents."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.arrays import LOWER, runs, slices, utf8
from feedlens.llm.batches import small_batches
from feedlens.session import ensure_checkpoint_dir

IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
IS_TERM[128:] = True
_LONG = 64  # bytes; longer terms are known by their digest, which no term can equal


def _digest(term: bytes) -> bytes:
    return b"\0" + hashlib.sha256(term).digest()


def term_array(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms of rows of bytes, the row of each, and the places of those longer than 64 bytes."""
    inside = IS_TERM[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    fresh[cuts] = inside[cuts]
    starts = np.flatnonzero(fresh)
    kept = np.append(0, np.cumsum(inside, dtype=np.int64))
    bounds = np.append(kept[starts], kept[-1])
    body = LOWER[data[inside]]
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    rows = np.searchsorted(offsets, starts, "right") - 1
    return terms, rows, np.flatnonzero(np.diff(bounds) > _LONG)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets):
            terms, rows, long = term_array(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if len(long):
                plain = terms.to_pylist()
                for i in long:
                    plain[i] = _digest(plain[i])
                terms = pa.array(plain, pa.large_binary())
            owners = batch.column("item_id").slice(a, b - a).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([owners, terms.cast(pa.binary())], ["item_id", "term"])


def _vectors(vocabulary):
    """Per row the number of its terms, and which terms of the vocabulary it has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(vocabulary.value, pa.large_binary())
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                size = b - a
                terms, rows, long = term_array(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found = pc.index_in(terms, value_set=words).fill_null(-1).to_numpy().astype(np.int64)
                if len(long):
                    digests = pa.array([_digest(terms[i].as_py()) for i in long], pa.large_binary())
                    found[long] = pc.index_in(digests, value_set=words).fill_null(-1).to_numpy()
                hit = found >= 0
                keys, times = np.unique(rows[hit] * max(1, len(words)) + found[hit], return_counts=True)
                owner, term = np.divmod(keys, max(1, len(words)))
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, size),
                        pa.array(np.bincount(rows, minlength=size).astype(np.int64)),
                        pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                    ],
                    ["id", "n", "terms", "times"],
                )

    return run


class BallTree:
    """Sparse rows in a binary tree; each node has the centroid of its rows and a radius around it.

    Rows come as (bounds, terms, values) with terms 0 .. width - 1. The radius is rounded up by more than the error
    of the squared distances, so a bound by centroid and radius is never too small.
    """

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int, leaf: int = 32) -> None:
        self.bounds, self.terms, self.values, self.width, self.leaf = bounds, terms, values, width, leaf
        self.norms = self._sums(values * values, bounds)
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray | None] = []
        self.radii: list[float] = []
        centres: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(np.arange(len(bounds) - 1), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.radii)
            if parent >= 0:
                pair = self.children[parent]
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            entries, ends = self._entries(rows)
            centre = np.bincount(self.terms[entries], self.values[entries], width) / max(1, len(rows))
            square = float(centre @ centre)
            away = np.maximum(self._far(entries, ends, rows, centre, square), 0)
            error = 1e-10 * (square + (float(self.norms[rows].max()) if len(rows) else 0.0))
            self.radii.append(math.sqrt((float(away.max()) if len(rows) else 0.0) + error))
            at = np.flatnonzero(centre)
            centres.append((at, centre[at]))
            if len(rows) <= leaf:
                self.children.append(None)
                self.members.append(rows)
                continue
            self.children.append((-1, -1))
            self.members.append(None)
            poles = []
            for _ in range(2):  # the row farthest from the centroid, and the one farthest from that
                pole = rows[int(np.argmax(away))]
                span = slice(bounds[pole], bounds[pole + 1])
                centre = np.zeros(width)
                centre[self.terms[span]] = self.values[span]
                away = self._far(entries, ends, rows, centre, float(self.norms[pole]))
                poles.append(away)
            order = np.argsort(poles[0] - poles[1], kind="stable")
            half = len(rows) // 2
            todo += [(np.sort(rows[order[half:]]), node, 1), (np.sort(rows[order[:half]]), node, 0)]
        sizes = [len(at) for at, _ in centres]
        nodes = np.repeat(np.arange(len(centres)), sizes)
        at = np.concatenate([c[0] for c in centres])
        order = np.argsort(at, kind="stable")  # by term: a query reads its own terms only
        self.centre_nodes, self.centre_values = nodes[order], np.concatenate([c[1] for c in centres])[order]
        self.centre_bounds = np.searchsorted(at[order], np.arange(width + 1))

    @staticmethod
    def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values))
        return total[ends[1:]] - total[ends[:-1]]

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        ends = np.append(0, np.cumsum(sizes))
        return np.arange(ends[-1]) - np.repeat(ends[:-1] - self.bounds[rows], sizes), ends

    def _far(self, entries, ends, rows, point: np.ndarray, square: float) -> np.ndarray:
        """Squared distances of rows from a point."""
        return self.norms[rows] + square - 2 * self._sums(self.values[entries] * point[self.terms[entries]], ends)

    def upper(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node a bound of the inner products of its rows with the query, safely rounded up."""
        parts = [slice(self.centre_bounds[t], self.centre_bounds[t + 1]) for t in terms]
        nodes = np.concatenate([self.centre_nodes[p] for p in parts])
        dots = np.concatenate([self.centre_values[p] * w for p, w in zip(parts, weights, strict=True)])
        dot = np.bincount(nodes, dots, len(self.radii))
        return (dot + math.sqrt(float(weights @ weights)) * np.array(self.radii)) * (1 + 1e-9) + 1e-6

    def leaves(self, upper: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(bound, rows) of the leaves, largest bound first; the caller stops when no bound can matter."""
        queue = [(-upper[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if self.members[node] is not None:
                yield -bound, self.members[node]
                continue
            for child in self.children[node]:
                heapq.heappush(queue, (max(bound, -upper[child]), child))


def _search(held, k: int, leaf: int):
    """Per shard the rows that can be among the ``k`` best of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        root = np.sqrt(q["weights"].astype(float))
        for shard in runs(batches, ["shard"]):
            lists = shard["terms"].combine_chunks()
            bounds = lists.offsets.to_numpy().astype(np.int64)
            bounds, flat = bounds - bounds[0], lists.flatten().to_numpy()
            times = shard["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
            n = shard["n"].to_numpy()
            m = 50 + (50 * n * q["rows"]) // max(1, q["total"])
            worth = (1_000_000_000 * times) // (1000 * times + 20 * np.repeat(m, np.diff(bounds)))
            here, local = np.unique(flat, return_inverse=True)
            tree = BallTree(bounds, local, worth * root[flat], len(here), leaf)
            items, rows, scores = [], [], []
            for i in range(len(q["items"])):
                wanted = q["terms"][q["bounds"][i] : q["bounds"][i + 1]]
                at = np.searchsorted(here, wanted)
                at[at == len(here)] = 0
                at = at[here[at] == wanted] if len(here) else at[:0]
                if not len(at):
                    continue
                weight = np.zeros(len(here), np.int64)
                weight[at] = q["weights"][here[at]]
                least = max(1, int(q["least"][i]))
                best, where = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for bound, members in tree.leaves(tree.upper(at, root[here[at]])):
                    if bound < least:
                        break
                    entries, ends = tree._entries(members)
                    score = BallTree._sums(weight[local[entries]] * worth[entries], ends)
                    use = score >= least
                    if not use.any():
                        continue
                    best, where = np.append(best, score[use]), np.append(where, members[use])
                    order = np.lexsort((where, -best))[:k]  # rows come by ascending id
                    best, where = best[order], where[order]
                    if len(best) == k:
                        least = max(least, int(best[-1]))
                items.append(np.full(len(best), i))
                rows.append(where)
                scores.append(best)
            if not items:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    q["items"].take(pa.array(np.concatenate(items))),
                    shard["id"].combine_chunks().take(pa.array(np.concatenate(rows))),
                    pa.array(np.concatenate(scores).astype(np.int64)),
                ],
                ["item_id", "doc_id", "score"],
            )

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 50,
    shard_rows: int = 4096,
    leaf_rows: int = 32,
    block_bytes: int = 1 << 24,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case. With N
    documents that have terms, L terms in all, n terms in a document, df documents with a term and
    tf its occurrences, a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document has
    m = 50 + 50 n N div L, and scores sum w ((10^9 tf) div (1000 tf + 20 m)) over the item's
    distinct terms, in 64-bit integers. Ties go to the smaller id, null ids last.

    Items are taken in blocks of about ``block_bytes`` of term bytes (usually one), whose vocabulary
    and terms are broadcast; one item larger than that is a block of its own. Documents become
    sparse vectors over the block's vocabulary, dealt over shards of about ``shard_rows``, one ball
    tree each. One shard in 64 is searched first: the k-th score there is a floor for all others.

    Rows of the same item id are one item with the terms of all; a null id is an item, too. Repeated
    document rows rank one by one. Null, empty and blank texts have no terms and are never
    found; items without terms, and empty tables, give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    pairs = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    pairs = pairs.mapInArrow(_item_terms, "item_id long, term binary").distinct().checkpoint()
    volume = pairs.agg(F.sum(F.length("term") + 8)).first()[0] or 0
    blocks = max(1, -(-volume // block_bytes))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = max(1, -(-rows.count() // shard_rows))
    samples = -(-shards // 64)

    found = []
    for block in range(blocks):
        asked = pairs.filter(F.col("block") == block).select("item_id", "term").toArrow()
        if not asked.num_rows:
            continue
        coded = pc.dictionary_encode(asked["term"].combine_chunks())
        vocabulary = spark.sparkContext.broadcast(coded.dictionary.to_pylist())
        shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
        vectors = rows.mapInArrow(_vectors(vocabulary), "id long, n long, terms array<int>, times array<int>")
        dealt = vectors.filter("n > 0").withColumn("shard", shard).repartition("shard")
        dealt = dealt.sortWithinPartitions("shard", F.col("id").asc_nulls_last()).checkpoint()
        n_rows, total = dealt.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(len(coded.dictionary), np.int64)
        for term, count in dealt.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            frequency[term] = count
        weights = [math.floor(1000 * math.log((2 * n_rows + 2) / (2 * df + 1))) for df in frequency.tolist()]

        table = pa.table({"item_id": asked["item_id"], "term": coded.indices}).sort_by([("item_id", "ascending"), ("term", "ascending")])
        owners = table["item_id"].combine_chunks().dictionary_encode("encode")
        bounds = np.searchsorted(owners.indices.to_numpy(), np.arange(len(owners.dictionary) + 1))
        query = {
            "items": owners.dictionary, "bounds": bounds, "terms": table["term"].to_numpy(),
            "weights": np.array(weights, np.int64), "rows": n_rows, "total": total,
            "least": np.zeros(len(owners.dictionary), np.int64),
        }
        shape = "item_id long, doc_id long, score long"
        first = dealt.filter(F.col("shard") < samples)
        first = _ranked(first.mapInArrow(_search(spark.sparkContext.broadcast(query), k, leaf_rows), shape), k).checkpoint()
        at = {item: i for i, item in enumerate(owners.dictionary.to_pylist())}
        for item, score in first.filter(F.col("rank") == k).select("item_id", "score").collect():
            query["least"][at[item]] = score
        rest = dealt.filter(F.col("shard") >= samples)
        rest = rest.mapInArrow(_search(spark.sparkContext.broadcast(query), k, leaf_rows), shape)
        found.append(_ranked(first.drop("rank").unionByName(rest), k))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, found).select("item_id", "rank", "doc_id", "score")
