"""Quality by a regularised quadratic discriminant over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.arrays import IS_SPACE, slices, span_hashes, utf8, word_bounds
from feedlens.llm.batches import small_batches

#: One per statistic, in the order of ``statistics``.
NAMES = (
    "log_words log_word_length upper symbols digits vocabulary top_word echoes marked_words entropy line_words same_lines"
).split()

_UPPER, _SYMBOL, _DIGIT, _CONTINUES = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_SYMBOL[[*map(ord, "!#$%&*+<=>@\\^_`{|}~")]] = True
_DIGIT[48:58] = True
_CONTINUES[128:192] = True  # bytes after the first of a character


def statistics(column) -> np.ndarray:
    """Transformed statistics of each text, one row per text; an empty text has all zeros."""
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    for first, end in slices(offsets):
        at = offsets[first : end + 1] - offsets[first]
        out[first:end] = _of_slice(data[offsets[first] : offsets[end]], at)
    return out


def _of_slice(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    out = np.zeros((n, len(NAMES)))
    starts, ends, rows = word_bounds(data, at)
    if not len(starts):
        return out

    def total(flags: np.ndarray) -> np.ndarray:
        """Sum of ``flags`` over each text's bytes."""
        sums = np.append(0, np.cumsum(flags, dtype=np.int64))
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    words = np.bincount(rows, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = np.maximum(total(~IS_SPACE[data]) - total(_CONTINUES[data]), 1)
    letters = np.maximum(total((data | 32) - 97 < 26), 1)
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.log(length / some)
    out[:, 2] = np.sqrt(total(_UPPER[data]) / letters)
    out[:, 3] = np.sqrt(total(_SYMBOL[data]) / length)
    out[:, 4] = np.sqrt(total(_DIGIT[data]) / length)

    hashes = span_hashes(data, starts, ends)
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    groups = np.flatnonzero(new)
    sizes = np.diff(np.append(groups, len(order)))
    owners = rows[order][groups]
    distinct = np.bincount(owners, minlength=n).astype(float)
    most = np.zeros(n)
    np.maximum.at(most, owners, sizes)
    out[:, 5] = np.log1p(distinct) / np.log1p(some)
    out[:, 6] = np.sqrt(most / some)
    again = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    out[:, 7] = np.sqrt(np.bincount(rows[1:][again], minlength=n) / some)
    out[:, 8] = np.sqrt(np.bincount(rows[_SYMBOL[data[ends - 1]]], minlength=n) / some)

    for i in range(n):
        share = np.bincount(data[at[i] : at[i + 1]], minlength=256)
        share = share[share > 0] / max(1, at[i + 1] - at[i])
        out[i, 9] = -(share * np.log2(share)).sum()
    lines = total(data == 10) + 1
    out[:, 10] = np.log1p(words / lines)
    out[:, 11] = _same_lines(data, at)
    out[words == 0] = 0
    return out


def _same_lines(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Root of the share of each text's lines that repeat an earlier one."""
    n = len(at) - 1
    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([at[:-1][at[:-1] < len(data)], cuts[cuts + 1 < len(data)] + 1]))
    rows = np.searchsorted(at, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), at[rows + 1])
    hashes = span_hashes(data, starts, ends)
    pairs = np.unique(np.stack([rows.astype(np.uint64), hashes]), axis=1)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=n)
    lines = np.maximum(np.bincount(rows, minlength=n), 1)
    return np.sqrt(1 - distinct / lines)


@dataclass(frozen=True)
class Discriminant:
    """Two normal densities over standardised statistics, kept as Cholesky factors."""

    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    prior: float
    temperature: float
    weak_words: float = 10.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Likelihood of class 1. The evidence of a text of w words counts w / (w + ``weak_words``)
        beside the prior, since statistics of few words vary at random."""
        z = (x - self.mean) / self.scale
        density = []
        for c in (0, 1):
            solved = np.linalg.solve(self.factors[c], (z - self.centres[c]).T)
            density.append(self.offsets[c] - 0.5 * (solved**2).sum(axis=0))
        words = np.expm1(x[:, 0])
        evidence = (density[1] - density[0]) / self.temperature * words / (words + self.weak_words)
        return 1 / (1 + np.exp(-np.clip(evidence + self.prior, -500, 500)))


def _fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float, temperature: float) -> Discriminant:
    d = len(NAMES)
    count = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
    total = sum(count.values())
    if not total:
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0, temperature)
    mean = sum(s[1] for s in sums.values()) / total
    square = sum(s[2] for s in sums.values()) / total
    scale = np.sqrt(np.maximum(np.diag(square) - mean**2, 1e-8))
    pooled = (square - np.outer(mean, mean)) / np.outer(scale, scale)
    centres, factors, offsets = np.zeros((2, d)), [], []
    for c in (0, 1):
        n = count[c]
        spread = pooled
        if n:
            m = sums[c][1] / n
            centres[c] = (m - mean) / scale
            own = (sums[c][2] / n - np.outer(m, m)) / np.outer(scale, scale)
            weight = n / (n + d)  # few rows lean on the pooled covariance
            spread = weight * own + (1 - weight) * pooled
        spread = (1 - shrinkage) * spread + shrinkage * np.eye(d)
        factors.append(np.linalg.cholesky(spread))
        offsets.append(-np.log(np.diag(factors[-1])).sum())
    prior = float(np.log((count[1] + 1) / (count[0] + 1)))
    return Discriminant(mean, scale, centres, np.stack(factors), np.array(offsets), prior, temperature)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array(list(statistics(batch.column("text"))), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), x], ["id", "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of each row; ``x`` is all zeros for a null or blank text."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_measure, "id long, x array<double>")


def fit(stats: DataFrame, labels: DataFrame, label_col: str, shrinkage: float = 0.05, temperature: float = 4.0) -> Discriminant:
    """The model from the sums of all labelled rows; ``labels`` has doc_id and 0/1 in ``label_col``.

    Labels that are null or not 0 or 1 are left out; of several labels of an id the largest counts.
    Only the sums, a few hundred numbers, reach the driver. Without labels all scores are 0.5.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    rows = stats.join(known, stats["id"] == known["doc_id"])
    flat = rows.select("y", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    sums = flat.groupBy("y").agg(
        F.count(F.lit(1)), *[F.sum(f"x{i}") for i in range(d)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]
    )
    found = {}
    for row in sums.collect():
        square = np.zeros((d, d))
        for (i, j), v in zip(pairs, row[2 + d :], strict=True):
            square[i, j] = square[j, i] = v
        found[row[0]] = (float(row[1]), np.array(row[2 : 2 + d], float), square)
    return _fit(found, shrinkage, temperature)


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(id, score) of measured rows."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held.value.scores(x))], ["id", "score"])

    return stats.mapInArrow(run, "id long, score double")


def keep_good(docs: DataFrame, model: Discriminant, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text scores at least ``least``, with all columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.scores(statistics(batch.column(text_col))) >= least))

    return small_batches(docs).mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted), one row per input row; learns from the rows that ``labels`` names.

    ``score`` (0 to 1) rises with the likelihood of label 1, ``predicted`` is 1 from 0.5 on. Null
    and blank texts are scored by their all-zero statistics. A null id is scored but never learned
    from; repeated rows are scored and learned from each. An empty table gives no rows; other
    columns are ignored.
    """
    stats = measured(docs, id_col, text_col).checkpoint()
    model = fit(stats, labels, label_col)
    return scored(stats, model).select(
        F.col("id").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
