"""Context-tree weighting over bytes, and a word-frequency score of the same texts.

Texts are normalised to words joined by one space and closed by a line feed, A-Z in lower case.
Every byte is eight binary choices; each choice is predicted in the tree of its context (none, the
last byte, the last two, ... ``depth`` bytes) by Krichevsky-Trofimov estimates of the training
counts. A node's weighted probability is half its own estimate and half the product of its
children's; the posterior share of "stop here" mixes the predictions of all depths on the path.
A context that training never reached is left out, and the deepest one known predicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.arrays import LOWER, runs, slices, span_hashes, utf8, word_bounds
from feedlens.llm.batches import small_batches
from feedlens.session import ensure_checkpoint_dir

_END = 10
_WORD, _GRAM = 0, 1
#: bytes of the texts whose grams are fetched together
_CHUNK = 1 << 22


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Bytes and offsets of the normalised texts, and the words' (starts, ends, rows) in the raw ones."""
    starts, ends, rows = word_bounds(data, at)
    length = ends - starts
    n = len(at) - 1
    # every word and one following byte (space, or line feed after the last), one byte for no word
    words = np.bincount(rows, minlength=n)
    per_text = np.bincount(rows, weights=length + 1, minlength=n).astype(np.int64) + (words == 0)
    offsets = np.append(0, np.cumsum(per_text))
    out = np.full(offsets[-1], 32, np.uint8)
    before = np.cumsum(length + 1) - (length + 1)  # target of each word, without the texts' extra bytes
    extra = np.append(0, np.cumsum(words == 0))[rows]
    target = before + extra
    if len(starts):
        steps = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(target, length) + steps] = LOWER[data[np.repeat(starts, length) + steps]]
    out[offsets[1:] - 1] = _END
    return out, offsets, (starts, ends, rows)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with the ``depth`` bytes before it in its text (zeros before the start), newest lowest."""
    key = data.astype(np.uint64)
    row_start = np.repeat(offsets[:-1], np.diff(offsets))
    position = np.arange(len(data)) - row_start
    for k in range(1, depth + 1):
        earlier = np.zeros(len(data), np.uint64)
        earlier[k:] = data[:-k] if k < len(data) else 0
        earlier[position < k] = 0
        key |= earlier << np.uint64(8 * k)
    return key.view(np.int64)


class _Counter:
    """Counts of 64-bit keys: new keys are gathered and merged when they are many."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, one: np.ndarray | None = None) -> None:
        """``one``: 1 where the key counts, 0 where it is only known."""
        distinct, inverse, number = np.unique(keys, return_inverse=True, return_counts=True)
        if one is not None:
            number = np.bincount(inverse, weights=one, minlength=len(distinct)).astype(np.int64)
        self.new.append((distinct, number))
        self.waiting += len(distinct)
        if self.waiting > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        counts = np.concatenate([self.counts, *(c for _, c in self.new)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        self.new, self.waiting = [], 0


def _count(depth: int, most: int = 1 << 21):
    """(kind, key, n): counts of training words, and of all texts' byte grams (n from training only)."""

    def rows_of(counter: _Counter, kind: int) -> Iterator[pa.RecordBatch]:
        counter.merge()
        for at in range(0, len(counter.keys), 1 << 17):
            keys, n = counter.keys[at : at + (1 << 17)], counter.counts[at : at + (1 << 17)]
            kinds = pa.array(np.full(len(keys), kind, np.int32))
            yield pa.RecordBatch.from_arrays([kinds, pa.array(keys), pa.array(n)], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pieces = _Counter(), _Counter()
        for batch in batches:
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                at = offsets[a : b + 1] - offsets[a]
                part = data[offsets[a] : offsets[b]]
                text, bounds, (starts, ends, rows) = normalised(part, at)
                words.add(span_hashes(part, starts, ends).view(np.int64)[learn[a:b][rows]])
                pieces.add(grams(text, bounds, depth), np.repeat(learn[a:b], np.diff(bounds)))
            for counter, kind in ((words, _WORD), (pieces, _GRAM)):
                if len(counter.keys) > most:
                    yield from rows_of(counter, kind)
                    counter.__init__()
        yield from rows_of(words, _WORD)
        yield from rows_of(pieces, _GRAM)

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0 by Stirling's series after eight steps up."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    half = _log_gamma(np.array([0.5]))[0]
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - 2 * half


_LEVEL = np.arange(8)


def _bit_nodes(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its eight nodes (1 to 255) and the bit taken at each."""
    node = (1 << _LEVEL)[None, :] | (symbol[:, None] >> (8 - _LEVEL)[None, :])
    bit = (symbol[:, None] >> (7 - _LEVEL)[None, :]) & 1
    return node, bit


class _Depth:
    """The nodes of one context length: sorted ids (context << 8 | node) with counts and weights."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> None:
        node, bit = _bit_nodes(symbol)
        ids = (context[:, None] << 8) | node
        self.ids, self.place = np.unique(ids, return_inverse=True)
        self.place = self.place.reshape(ids.shape)
        weight = np.broadcast_to(n[:, None], ids.shape).ravel()
        flat = self.place.ravel()
        ones = np.bincount(flat, weights=weight * bit.ravel(), minlength=len(self.ids))
        zeros = np.bincount(flat, weights=weight, minlength=len(self.ids)) - ones
        self.seen = (zeros + ones) > 0
        self.own = _log_kt(zeros, ones)
        self.one = (ones + 0.5) / (zeros + ones + 1.0)
        self.weighted = self.own

    def mix(self, children: np.ndarray) -> None:
        """``children``: sum of the children's weighted log probabilities per node."""
        self.weighted = np.logaddexp(self.own, children) - np.log(2)

    @property
    def stop(self) -> np.ndarray:
        return np.exp(np.minimum(0, self.own - np.log(2) - self.weighted))


def _depths(key: np.ndarray, n: np.ndarray, shallow: int, depth: int) -> list[_Depth]:
    """Nodes of context lengths ``shallow`` to ``depth`` with weights from the bottom up."""
    symbol = key & 255
    levels = [_Depth((key >> 8) & ((1 << (8 * d)) - 1), symbol, n) for d in range(shallow, depth + 1)]
    for d in range(len(levels) - 2, -1, -1):
        below = levels[d + 1]
        context = (below.ids >> 8) & ((1 << (8 * (shallow + d))) - 1)
        parent = np.searchsorted(levels[d].ids, (context << 8) | (below.ids & 255))
        levels[d].mix(np.bincount(parent, weights=below.weighted, minlength=len(levels[d].ids)))
    return levels


def _roots(depth: int):
    """Per group of the last two bytes: what its nodes give to those of the last byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["pair"]):
            key, n = t["key"].to_numpy(), t["n"].to_numpy()
            top = _depths(key, n, 2, depth)[0]
            node = (top.ids >> 8 & 255) << 8 | (top.ids & 255)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(top.weighted)], ["node", "below"])

    return run


def _crown(bytes_after: DataFrame, below: DataFrame):
    """(stop, one, seen) of the empty context and of the 256 one-byte contexts: at most 65,536 nodes."""
    last = np.array([tuple(r) for r in bytes_after.collect()], np.int64).reshape(-1, 2)
    sums = dict(map(tuple, below.collect()))
    levels = _depths(last[:, 0], last[:, 1], 0, 1)
    levels[1].mix(np.array([sums.get(i, 0.0) for i in levels[1].ids.tolist()]))
    parent = np.searchsorted(levels[0].ids, levels[1].ids & 255)
    levels[0].mix(np.bincount(parent, weights=levels[1].weighted, minlength=len(levels[0].ids)))
    return [(x.ids, x.stop, x.one, x.seen) for x in levels]


def _predict(crown, depth: int):
    """(key, p): log10 probability of the byte in its context, for every gram of the corpus."""

    def of_group(key: np.ndarray, n: np.ndarray) -> np.ndarray:
        node, bit = _bit_nodes(key & 255)
        chance, rest = np.zeros(node.shape), np.ones(node.shape)
        final, open_ = np.full(node.shape, 0.5), np.ones(node.shape, bool)
        levels = [(ids, stop, one, seen) for ids, stop, one, seen in crown.value]
        levels += [(x.ids, x.stop, x.one, x.seen) for x in _depths(key, n, 2, depth)]
        for d, (ids, stop, one, seen) in enumerate(levels):
            context = (key >> 8) & ((1 << (8 * d)) - 1)
            at = np.searchsorted(ids, (context[:, None] << 8) | node)
            open_ &= seen[at]
            final = np.where(open_, chance + rest * one[at], final)  # as if this were the deepest
            share = np.where(open_, stop[at], 0)
            chance, rest = chance + rest * share * one[at], rest * (1 - share)
        taken = np.where(bit == 1, final, 1 - final)
        return np.log10(np.maximum(taken, 1e-300)).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["pair"]):
            key, n = t["key"].to_numpy(), t["n"].to_numpy()
            yield pa.RecordBatch.from_arrays([t["key"].combine_chunks(), pa.array(of_group(key, n))], ["key", "p"])

    return run


def _head_words(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of at least some count, at most ``most`` of them: the least such power of 2**(1/8)."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((s, c) for s, c in words.groupBy(step.alias("s")).agg(F.count(F.lit(1))).collect()), reverse=True)
    total, least = 0, None
    for s, c in sizes:
        if total + c > most:
            break
        total, least = total + c, s
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = words.filter(step >= least).select("key", "n").toArrow()
    order = np.argsort(head["key"].to_numpy())
    return head["key"].to_numpy()[order], head["n"].to_numpy()[order]


def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the keys, and which keys the sorted table has."""
    have, values = table
    if not len(have):
        return np.zeros(len(keys), values.dtype), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return values[at], have[at] == keys


def _score(depth: int, head, model, spell: bool):
    """Per row what the broadcast tables tell, and the words (and the text, by chunk) left to join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                at = offsets[a : b + 1] - offsets[a]
                part = data[offsets[a] : offsets[b]]
                text, bounds, (starts, ends, rows) = normalised(part, at)
                keys = span_hashes(part, starts, ends).view(np.int64)
                n, known = _lookup(head.value, keys)
                size = b - a
                words = np.bincount(rows, minlength=size)
                logs = np.bincount(rows[known], weights=np.log10(n[known] + 0.1), minlength=size)
                rest = pa.ListArray.from_arrays(
                    np.append(0, np.cumsum(np.bincount(rows[~known], minlength=size))).astype(np.int32), pa.array(keys[~known])
                )
                if spell:
                    if filled and filled + len(text) > _CHUNK:
                        chunk, filled = chunk + 1, 0
                    filled += len(text)
                    raw = text.tobytes()
                    p = np.zeros(size)
                    left = pa.array([raw[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                else:
                    p = _spelled(model.value, text, bounds, depth)
                    left = pa.nulls(size, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, size),
                        pa.array(words.astype(np.int64)),
                        pa.array(np.bincount(rows[known], minlength=size).astype(np.int64)),
                        pa.array(logs.astype(np.float64)),
                        pa.array(np.diff(bounds)),
                        pa.array(p),
                        rest,
                        left,
                        pa.array(np.full(size, chunk, np.int64)),
                    ],
                    ["id", "words", "known", "logs", "bytes", "p", "rest", "left", "chunk"],
                )

    return run


def _spelled(table: tuple[np.ndarray, np.ndarray], text: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """The sum of the table's values over the grams of each text."""
    distinct, inverse = np.unique(grams(text, bounds, depth), return_inverse=True)
    value, _ = _lookup(table, distinct)
    sums = np.append(0, np.cumsum(value[inverse]))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _joined_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offset of each value (one more than values)."""
    values = column.to_pylist()
    bounds = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int64)
    return np.frombuffer(b"".join(values), np.uint8), bounds


def _asked(depth: int):
    """(chunk, key): the distinct grams of each chunk, once for every batch that holds a part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            starts = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])) if len(chunks) else np.zeros(0, np.int64)
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(chunks)], strict=True):
                keys = np.unique(grams(*_joined_bytes(batch.column("left").slice(start, end - start)), depth))
                for at in range(0, len(keys), 1 << 17):
                    part = keys[at : at + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunks[start])), pa.array(part)], ["chunk", "key"])

    return run


def _answered(depth: int):
    """The rows of one chunk with what its grams give."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        key, p = found["key"].to_numpy(), found["p"].to_numpy()
        order = np.argsort(key)
        text, bounds = _joined_bytes(texts["left"])
        return pa.table({"row": texts["row"], "spelled": _spelled((key[order], p[order]), text, bounds, depth)})

    return run


def context_tree_scores(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 4,
    head_words: int = 1 << 20,
    broadcast_grams: int = 1 << 22,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per input row.

    Rows where ``learn`` holds are the training texts. ``score`` is the log10 probability of the
    normalised text under the context tree, ``bits_per_byte`` its code length. ``base_score`` sums
    log10((c + 0.1) / (N + 0.1 (V + 1))) over words and one end token, where c, N and V are counts
    of training tokens; ``n_known`` tokens have c > 0.

    The probabilities of the corpus's grams are broadcast up to ``broadcast_grams`` rows and
    joined beyond, once for each gram of a chunk of texts (4 MB, a longer text by itself); the counts of the ``head_words`` most frequent words are broadcast, those of
    the others joined. Words are compared by 64-bit hashes. A null text is empty: one end token.
    Rows with a null ``learn`` are not learned from. Without training texts every bit costs one
    half. Repeated rows are learned from and scored each; an empty table gives no rows; other
    columns are ignored.
    """
    if depth < 2:
        raise ValueError("depth must be at least 2")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = small_batches(docs).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    counted = rows.mapInArrow(_count(depth), "kind int, key long, n long")
    counts = counted.groupBy("kind", "key").agg(F.sum("n").alias("n")).checkpoint()
    words = counts.filter((F.col("kind") == _WORD) & (F.col("n") > 0)).select("key", "n")
    pieces = counts.filter(F.col("kind") == _GRAM).select("key", "n")

    ends = rows.filter("learn").count()
    told = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = told[0] + ends, told[1] + (ends > 0)
    size = total + 0.1 * (distinct + 1)

    pair = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    grouped = pieces.withColumn("pair", pair).repartition("pair").sortWithinPartitions("pair", "key")
    below = grouped.mapInArrow(_roots(depth), "node long, below double").groupBy("node").agg(F.sum("below"))
    after = pieces.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n"))
    crown = spark.sparkContext.broadcast(_crown(after, below))
    model = grouped.mapInArrow(_predict(crown, depth), "key long, p double").checkpoint()

    spell = model.count() > broadcast_grams
    table = (np.zeros(0, np.int64), np.zeros(0))
    if not spell:
        whole = model.toArrow()
        order = np.argsort(whole["key"].to_numpy())
        table = whole["key"].to_numpy()[order], whole["p"].to_numpy()[order]
    head = spark.sparkContext.broadcast(_head_words(words, head_words))
    shape = "id long, words long, known long, logs double, bytes long, p double, rest array<long>, left binary, chunk long"
    scored = rows.mapInArrow(_score(depth, head, spark.sparkContext.broadcast(table), spell), shape)
    scored = scored.withColumn("row", F.monotonically_increasing_id()).checkpoint()

    keys = scored.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    counted_in = keys.join(words, "key", "left").groupBy("row")
    rare = counted_in.agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_n")
    )
    out = scored.join(rare, "row", "left")
    if spell:
        texts = scored.select("chunk", "row", "left")
        found = texts.select("chunk", "left").mapInArrow(_asked(depth), "chunk long, key long").join(model, "key")
        told = texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_answered(depth), "row long, spelled double")
        out = out.join(told, "row", "left").withColumn("p", F.coalesce("spelled", F.lit(0.0)))
    nothing = F.coalesce(F.col("rare_n"), F.lit(0))
    unknown = F.col("words") - F.col("known") - nothing
    tokens = F.col("words") + 1
    logs = F.col("logs") + F.coalesce("rare", F.lit(0.0)) + unknown * F.log10(F.lit(0.1)) + float(np.log10(ends + 0.1))
    return out.select(
        F.col("id").alias("doc_id"),
        tokens.alias("n_tokens"),
        (F.col("known") + nothing + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - tokens * float(np.log10(size))).alias("base_score"),
        F.col("p").alias("score"),
        (-F.col("p") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )
