"""Byte-level BPE by given ranks, with segment trees over byte positions.

A tree's leaf at a byte holds the rank of the pair that starts there, joined with the position,
so the root is the leftmost pair of least rank. A merge changes three leaves: the merged pair's,
its left neighbour's, and that of the part that is gone. Short pieces are merged many at a time
(one tree per row of a matrix), long ones one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.batches import small_batches

_NONE = np.int64(1) << np.int64(62)
_SHORT = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes pieces of text and decodes ids. Every byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            (ranks[t[:i]] << 32) | ranks[t[i:]]: rank
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.pairs = pairs
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers, which take little room
        self.old: dict[str, bytes] = {}

    def _ranked(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Leaf values of pairs; -1 stands for a missing neighbour."""
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (left >= 0) & (right >= 0) & (self.pair_keys[at] == key)
        return np.where(found, (self.pair_ranks[at] << np.int64(32)) | position, _NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of 2 to 64 bytes, all rows merged in step."""
        out = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        width = 2
        while width <= _SHORT:
            rows = np.flatnonzero((sizes <= width) & (sizes > width // 2) | (sizes < 2) & (width == 2))
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                for i, ids in zip(part.tolist(), self._merge_rows([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
            width *= 2
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        m = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        ids = np.full((m, width + 2), -1, np.int64)  # a column of -1 on either side
        inside = np.arange(width)[None, :] < size[:, None]
        ids[:, 1:-1] = np.where(inside, self.byte_ids[raw], -1)
        after = np.broadcast_to(np.arange(1, width + 3), (m, width + 2)).copy()
        before = after - 2
        tree = np.full((m, 2 * width), _NONE)
        place = np.broadcast_to(np.arange(width, dtype=np.int64), (m, width))
        tree[:, width:] = self._ranked(ids[:, 1:-1], ids[:, 2:], place)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(rows: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
            node = position + width
            tree[rows, node] = value
            while width > 1 and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            best = tree[rows, 1]
            at, rank = (best & np.int64(0xFFFFFFFF)) + 1, best >> np.int64(32)
            gone = after[rows, at]
            following = after[rows, gone]
            ids[rows, at], ids[rows, gone] = rank, -1
            after[rows, at] = following
            before[rows, following] = at
            put(rows, gone - 1, np.full(len(rows), _NONE))
            next_id = np.where(following <= width, ids[rows, np.minimum(following, width + 1)], -1)
            put(rows, at - 1, self._ranked(rank, next_id, at - 1))
            left = before[rows, at]
            some = left >= 1
            if some.any():
                r, p = rows[some], left[some]
                put(r, p - 1, self._ranked(ids[r, p], rank[some], p - 1))
            rows = rows[tree[rows, 1] < _NONE]
        flat = ids[:, 1:-1]
        coded = flat[flat >= 0].astype(np.int32).tobytes()
        ends = (4 * np.cumsum((flat >= 0).sum(axis=1))).tolist()
        return [coded[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one piece of any length."""
        n, pairs = len(piece), self.pairs
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        width = 1 << max(1, (n - 1).bit_length())
        none = 1 << 62

        def value(left: int, right: int) -> int:
            rank = pairs.get((ids[left] << 32) | ids[right])
            return none if rank is None else (rank << 32) | left

        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = value(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(position: int, new: int) -> None:
            node = position + width
            tree[node] = new
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low

        alive = [True] * n
        while (best := tree[1]) < none:
            at, rank = best & 0xFFFFFFFF, best >> 32
            gone = after[at]
            following = after[gone]
            ids[at], alive[gone], after[at] = rank, False, following
            put(gone, none)
            if following < n:
                before[following] = at
                put(at, value(at, following))
            else:
                put(at, none)
            if (left := before[at]) >= 0:
                put(left, value(left, at))
        return np.array([i for i, kept in zip(ids, alive, strict=True) if kept], np.int32).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Adds the ids of unseen pieces to the cache. It holds two generations of a bounded number:
        a full one becomes the old one, from which pieces in use come back."""
        if len(self.known) > 200_000:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = [p for p in pieces if p not in known]
        if old:
            known.update((p, old[p]) for p in new if p in old)
            new = [p for p in new if p not in known]
        coded = [p.encode("utf-8", "surrogatepass") for p in new]
        short = []
        for p, b in zip(new, coded, strict=True):
            if (rank := self.ranks.get(b)) is not None:
                self.known[p] = np.int32(rank).tobytes()
            elif len(b) <= _SHORT:
                short.append((p, b))
            else:
                self.known[p] = self.merge_long(b)
        merged = self.merge_many([b for _, b in short])
        self.known.update(zip((p for p, _ in short), merged, strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as 32-bit numbers."""
        split = [self.pattern.findall(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        known = self.known
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def _by_size(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start = i
            total = 0
        total += len(t)
    if texts:
        yield start, len(texts)


def bpe_round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded), one row per input row: the ids of the whole text and the bytes they give back.

    Each match of ``pattern`` is merged alone; there are no special tokens. The ranks (a bounded
    vocabulary) are broadcast. A null text is empty and has no ids. Null ids and repeated rows keep
    their rows; an empty table gives none; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*held.value)
        for batch in batches:
            names, texts = batch.column("id"), batch.column("text").fill_null("").to_pylist()
            for a, b in _by_size(texts):
                ids = encoder.encode(texts[a:b])
                at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids)
                decoded = [encoder.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, b - a), pa.ListArray.from_arrays(at, flat), pa.array(decoded, pa.binary())], ["id", "ids", "decoded"]
                )

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    coded = rows.mapInArrow(run, "id long, ids array<int>, decoded binary")
    return coded.withColumnRenamed("id", "doc_id")
