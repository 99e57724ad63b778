"""Toxicity by compression distance: how much better the toxic dictionary packs a window.

Both zstandard dictionaries hold the same ordinary text. The toxic one ends with the words that
set the toxic training texts apart, the other with as many inert bytes, so positions agree and the
packed lengths of a window differ by what the toxic words save. Only matches of six bytes or more
count and literals stay uncoded, which keeps the lengths steady elsewhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.arrays import IS_SPACE, LOWER, slices, utf8
from feedlens.llm.batches import small_batches

_GRAM = 6
_N = 5  # features of a text
_LONGEST = 32  # bytes of a dictionary word


def _grams(text: np.ndarray) -> np.ndarray:
    key = np.zeros(max(0, len(text) - _GRAM + 1), np.uint64)
    for j in range(_GRAM if len(key) else 0):
        key = (key << np.uint64(8)) | text[j : len(text) - _GRAM + 1 + j].astype(np.uint64)
    return key


def _frequencies(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    each = [np.unique(_grams(t)) for t in texts]
    return np.unique(np.concatenate(each) if each else np.zeros(0, np.uint64), return_counts=True)


def _telling_grams(toxic: list[np.ndarray], ordinary: list[np.ndarray], hits: int = 3, most: int = 400) -> np.ndarray:
    """Grams that cover the toxic texts ``hits`` times and hardly occur in ordinary ones.

    They are chosen one by one by the texts they newly cover, so a family of near copies, once
    covered, cannot vote for its own phrases.
    """
    keys, count = _frequencies(toxic)
    others, other_count = _frequencies(ordinary)
    if not len(keys):
        return keys
    at = np.minimum(np.searchsorted(others, keys), max(0, len(others) - 1))
    there = np.where(others[at] == keys, other_count[at], 0) if len(others) else np.zeros(len(keys), int)
    least = max(3, len(toxic) * 0.002)
    keys = keys[(there <= len(ordinary) * 0.0005) & (count >= max(least, len(toxic) * 0.004))]
    if not len(keys):
        return keys
    has = np.zeros((len(toxic), len(keys)), bool)
    for row, text in enumerate(toxic):
        found = np.unique(_grams(text))
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        has[row, at[keys[at] == found]] = True
    need, chosen = np.full(len(toxic), hits), []
    while len(chosen) < most:
        gain = has[need > 0].sum(axis=0)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen.append(best)
        need[has[:, best]] -= 1
        has[:, best] = False
    return keys[np.sort(chosen)] if chosen else keys[:0]


def _words_with(text: np.ndarray, grams: np.ndarray, longest: int = _LONGEST) -> set[bytes]:
    """The words, with the spaces around them, in which the grams occur."""
    keys = _grams(text)
    if not len(keys) or not len(grams):
        return set()
    at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
    raw, out = text.tobytes().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")), set()
    for hit in np.flatnonzero(grams[at] == keys).tolist():
        middle = hit + 2
        start = max(0, raw.rfind(b" ", 0, middle + 1))
        end = raw.find(b" ", middle + 1)
        out.add(raw[start : len(raw) if end < 0 else end + 1][:longest])
    return out


@dataclass(frozen=True)
class Distances:
    """The two dictionaries and the calibration of the texts' features."""

    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    window: int

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        form = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
            strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=_GRAM, hash_log=20, window_log=20,
        )

        def of(content: bytes) -> zstandard.ZstdCompressor:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=form)

        return of(self.ordinary), of(self.toxic)

    def features(self, compressors, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per text: largest saving, mean of the three largest, windows that save 3 or more, and sums."""
        size = at[1:] - at[:-1]
        number = np.maximum(1, -(-size // self.window))
        first = np.cumsum(number) - number
        rows = np.repeat(np.arange(len(size)), number)
        step = (np.arange(number.sum()) - first[rows]) * self.window
        start = at[:-1][rows] + step
        end = np.minimum(start + self.window, at[1:][rows])
        cut = np.flatnonzero(step)  # moved back to white space, which both sides keep; without any near, the sides overlap
        spaces = np.append(-1 - _LONGEST, np.flatnonzero(IS_SPACE[data]))
        space = spaces[np.searchsorted(spaces, start[cut], "right") - 1]
        far = np.maximum(start[cut] - _LONGEST, at[:-1][rows[cut]])
        end[cut - 1] = np.where(space >= far, space + 1, start[cut])
        start[cut] = np.where(space >= far, space, far)
        length = end - start
        live = length > 0
        saved = np.zeros(len(rows), np.int64)
        if live.any():
            segments = np.stack([start, length], axis=1)[live].astype(np.uint64).tobytes()
            whole = zstandard.BufferWithSegments(LOWER[data].tobytes(), segments)
            packed = [c.multi_compress_to_buffer(whole, threads=1) for c in compressors]
            one, two = (np.fromiter((len(p[i]) for i in range(len(p))), np.int64, len(p)) for p in packed)
            saved[live] = one - two
        out = np.zeros((len(size), _N))
        gain = np.maximum(saved, 0)
        total = np.add.reduceat(gain, first) if len(first) else gain
        order = np.lexsort((-saved, rows))
        ranked = saved[order]
        out[:, 0] = ranked[first]
        top = [np.where(number > k, ranked[np.minimum(first + k, len(ranked) - 1)], 0) for k in range(3)]
        out[:, 1] = sum(top) / np.minimum(3, number)
        out[:, 2] = np.log1p(np.add.reduceat((saved >= 3).astype(np.int64), first))
        out[:, 3] = np.log1p(total)
        out[:, 4] = np.minimum(30, total / np.sqrt(number))
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -500, 500)))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and logistic weights; the level 0.5 lies where the classes are told best, an
    ordinary text that is marked counting three times its share."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
        w += np.linalg.solve(curve, z.T @ (y - p) - 0.1 * w)
    level = z @ w
    order = np.argsort(level)
    below = np.append(0, np.cumsum(y[order]))  # toxic texts under each cut
    clean = np.append(0, np.cumsum(1 - y[order]))
    told = 3 * clean / max(1, clean[-1]) - below / max(1, below[-1])
    cuts = np.flatnonzero(told >= told.max() - 1e-12)
    edges = np.concatenate([[level[order[0]] - 1], (level[order][1:] + level[order][:-1]) / 2, [level[order[-1]] + 1]])
    w[0] -= edges[cuts[len(cuts) // 2]]
    return centre, scale, w


def train(texts: list[str], toxic: list[bool], window: int = 256, ordinary_bytes: int = 120_000) -> Distances | float:
    """Dictionaries from two thirds of the texts, calibration on the rest; without both classes
    the constant score: the share of toxic texts, one half for none."""
    seen: dict[str, bool] = {}
    for text, mark in zip(texts, toxic, strict=True):
        seen.setdefault(text, mark)
    raw = [LOWER[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)] for t in seen]
    marks = np.array(list(seen.values()), bool)
    learn = np.arange(len(raw)) % 3 != 2
    bad = [t for t, m, u in zip(raw, marks, learn, strict=True) if m and u]
    good = [t for t, m, u in zip(raw, marks, learn, strict=True) if not m and u]
    if not bad or not good or len(set(marks[~learn])) < 2:
        return float(marks.mean()) if len(marks) else 0.5
    grams = _telling_grams(bad, good)
    words = Counter(w for t in bad for w in _words_with(t, grams))
    chosen = sorted((n, w) for w, n in words.items() if n >= 3)[-300:]  # frequent words last, where they are cheapest
    tail = b"\0".join(w for _, w in chosen) + b"\0"
    base, total = [], 0
    for t in good:
        if total >= ordinary_bytes:
            break
        base.append(t.tobytes()[: ordinary_bytes - total])
        total += len(base[-1]) + 1
    shared = b" ".join(base)
    empty = np.zeros(_N)
    model = Distances(shared + b"\1" * len(tail), shared + tail, empty, empty + 1, np.zeros(_N + 1), window)
    rest = [raw[i] for i in np.flatnonzero(~learn)]
    data, at = np.concatenate(rest), np.append(0, np.cumsum([len(t) for t in rest]))
    x = model.features(model.compressors(), data, at)
    return Distances(model.ordinary, model.toxic, *_calibrated(x, marks[~learn].astype(float)), window)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    train_toxic: int = 2000,
    train_ordinary: int = 5000,
    train_chars: int = 32_768,
) -> DataFrame:
    """(doc_id, score, predicted), one row per input row; learns from rows that ``labels`` names.

    The sample for training is bounded: of each class the ``train_toxic`` or ``train_ordinary``
    ids that come first by hash, texts of up to ``train_chars`` characters. Every whole text is
    scored, window by window. ``score`` (0 to 1) rises with the likelihood of toxicity, ``predicted``
    is 1 from 0.5 on. Null and empty texts save nothing and are scored so. Labels other than 0 and 1
    are left out; of several labels of an id the largest counts. Repeated rows are scored each; an
    empty table gives no rows; other columns are ignored.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("mark"))
    drawn = [
        known.filter(F.col("mark") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for mark, most in ((1, train_toxic), (0, train_ordinary))
    ]
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = F.broadcast(drawn[0].union(drawn[1]))  # at most train_toxic + train_ordinary rows
    sample = rows.filter(F.length("text") <= train_chars).join(picked, F.col("id") == F.col("doc_id"))
    sample = sample.select("id", "text", "mark").toArrow().sort_by("id")
    model = train(sample["text"].to_pylist(), [m == 1 for m in sample["mark"].to_pylist()])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        compressors = model.compressors() if isinstance(model, Distances) else None
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                if compressors:
                    at = offsets[a : b + 1] - offsets[a]
                    score = model.scores(model.features(compressors, data[offsets[a] : offsets[b]], at))
                else:
                    score = np.full(b - a, model)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(score)], ["id", "score"])

    scored = rows.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
