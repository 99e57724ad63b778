"""Language of a text by interpolated Kneser-Ney models over characters, one per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.arrays import mix
from feedlens.llm.batches import small_batches
from feedlens.session import ensure_checkpoint_dir

UNKNOWN = "und"
_SPACE = 32
_FACTORS = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Code points: 2 not yet looked at, 1 a letter, 0 none.
_letters = np.full(0x110000, 2, np.uint8)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    kinds = _letters[codes]
    if (kinds == 2).any():
        new = np.unique(codes[kinds == 2])
        _letters[new] = [chr(c).isalpha() for c in new.tolist()]
        kinds = _letters[codes]
    return kinds == 1


def letters(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts in lower case: words, each with one space after it.

    Each text is led by ``order`` spaces that only serve as context. Returned are the code points,
    the offset of each text, and whether a code point counts. A text without letters has none.
    """
    folded = [(t or "").lower() for t in texts]
    raw = np.frombuffer("".join(t + " " for t in folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in folded], dtype=np.int64) - 1  # the space after each text
    letter = _is_letter(raw)
    keep = ~letter
    keep[:1] = False
    keep[1:] &= letter[:-1]  # the first character after each word, at last the space after the text
    keep |= letter
    places = np.flatnonzero(keep)
    codes, owner = np.where(letter, raw, _SPACE)[places], np.searchsorted(ends, places, "left")
    sizes = np.bincount(owner, minlength=len(texts))
    some = sizes > 0
    at = np.append(0, np.cumsum(np.where(some, sizes + order, 0)))
    out = np.full(at[-1], _SPACE, np.uint32)
    place = np.arange(len(codes)) - np.append(0, np.cumsum(sizes))[owner] + at[owner] + order
    out[place] = codes
    counted = np.ones(len(out), bool)
    for i in range(order):
        counted[(at[:-1] + i)[some]] = False
    return out, at, counted


def gram_hashes(chars: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` characters that end at each place, from the hashes of characters."""
    total = np.full(len(places), width, np.uint64)
    for back in range(width):
        total += chars[places - back] * _FACTORS[back]
    return mix(total)


def char_hashes(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(1))


@dataclass(frozen=True)
class Models:
    """Kneser-Ney models of all languages; per order the hashes in ascending order and a value per language.

    ``probability[k]`` has the interpolated probability of a gram of k + 1 characters, where that
    language has it (else 0); ``back_off[k]`` the weight of the shorter context, else 1.
    """

    names: list[str]
    grams: list[np.ndarray]
    probability: list[np.ndarray]
    contexts: list[np.ndarray]
    back_off: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray
    slope: float = 1.0
    power: float = 0.5

    @property
    def order(self) -> int:
        return len(self.grams)

    def bits(self, codes: np.ndarray, at: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text in each language, and the characters; places hold whole texts."""
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))[counted]
        chars, places = char_hashes(codes), np.flatnonzero(counted)
        distinct, inverse = np.unique(gram_hashes(chars, places, self.order), return_inverse=True)
        place = np.zeros(len(distinct), np.int64)
        place[inverse] = places  # any place of the gram
        p = np.repeat(self.floor[None], len(place), 0)
        for k in range(self.order):
            if k:
                p = p * _values(self.contexts[k], self.back_off[k], gram_hashes(chars, place - 1, k), 1.0)
            own = _values(self.grams[k], self.probability[k], gram_hashes(chars, place, k + 1), 0.0)
            p = np.where(own > 0, own, p)
        cost = -np.log2(p)
        n = np.bincount(rows, minlength=len(at) - 1)
        total = np.stack([np.bincount(rows, cost[:, c][inverse], len(at) - 1) for c in range(len(self.names))], 1)
        return total / np.maximum(n, 1)[:, None], n

    def decide(self, bits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the best language, its calibrated share (0 to 1), and whether it is worse than its limit."""
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        level = -(bits - least[:, None]) * (self.slope * np.power(np.maximum(n, 1), self.power))[:, None]
        share = 1 / np.exp(np.maximum(level, -700)).sum(axis=1)
        return best, share, least > self.limits[best]


def _values(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, missing: float) -> np.ndarray:
    """Rows of ``values`` at the asked keys of a sorted array."""
    if not len(keys):
        return np.full((len(asked), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where((keys[at] == asked)[:, None], values[at], missing)


def _kneser_ney(codes: np.ndarray, counted: np.ndarray, order: int):
    """Per order (gram hashes, interpolated probabilities, context hashes, back-off weights) of one language.

    Highest order: counts; below: the number of different characters seen before a gram. Each order
    takes off a discount n1 / (n1 + 2 n2) and hands the mass to the order below; the lowest to a uniform floor.
    """
    chars, places = char_hashes(codes), np.flatnonzero(counted)
    keys, first, count = np.unique(gram_hashes(chars, places, order), return_index=True, return_counts=True)
    levels = [(keys, places[first], count.astype(float))]
    for width in range(order - 1, 0, -1):
        at = levels[-1][1]  # one place of each longer gram: those with the same end differ in the character before
        keys, first, count = np.unique(gram_hashes(chars, at, width), return_index=True, return_counts=True)
        levels.append((keys, at[first], count.astype(float)))
    levels.reverse()
    out, floor = [], 1.0 / (len(levels[0][0]) + 1)
    for width, (keys, at, count) in enumerate(levels, 1):
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once else 0.5
        context = gram_hashes(chars, at - 1, width - 1) if width > 1 else np.zeros(len(at), np.uint64)
        names, where = np.unique(context, return_inverse=True)
        mass = np.bincount(where, count)
        weight = np.bincount(where, np.minimum(count, discount)) / mass
        if width == 1:
            below = np.full(len(keys), floor)
        else:
            short = gram_hashes(chars, at, width - 1)
            below = out[-1][1][np.searchsorted(out[-1][0], short)]
        share = np.maximum(count - discount, 0) / mass[where] + weight[where] * below
        out.append((keys, share, names, weight))
    return out, floor * out[0][3][0]


def train(texts: list[str], languages: list[str], order: int = 5, quantile: float = 0.999) -> Models | None:
    """Models from two thirds of each language's texts, calibration on the rest; None without any letter."""
    codes, at, counted = letters(texts, order - 1)
    some = np.diff(at) > 0
    names = sorted({name for name, s in zip(languages, some, strict=True) if s})
    if not names:
        return None
    label = np.array([names.index(name) if s else -1 for name, s in zip(languages, some, strict=True)])
    held = np.zeros(len(label), bool)
    for c in range(len(names)):
        mine = np.flatnonzero(label == c)
        held[mine[2::3]] = True
    rows = np.repeat(np.arange(len(label)), np.diff(at))
    parts = []
    for c in range(len(names)):
        part = ((label == c) & ~held)[rows]
        parts.append(_kneser_ney(codes[part], counted[part], order))
    tables: list[list[np.ndarray]] = [[], [], [], []]
    for k in range(order):
        for key, value, missing in ((0, 1, 0.0), (2, 3, 1.0)):
            union = np.unique(np.concatenate([p[0][k][key] for p in parts]))
            tables[key].append(union)
            tables[value].append(np.concatenate([_values(p[0][k][key], p[0][k][value][:, None], union, missing) for p in parts], 1))
    floor = np.array([p[1] for p in parts])
    models = Models(names, *tables, floor, np.full(len(names), np.inf))
    if not held.any():
        return models
    bits, n = _of_texts(models, [t for t, h in zip(texts, held, strict=True) if h])
    truth = label[held]
    limits = np.full(len(names), np.inf)
    for c in range(len(names)):
        own = bits[truth == c, c]
        if len(own):
            limits[c] = np.quantile(own, quantile) + 3 * own.std() / np.sqrt(len(own))
    best = (np.inf, 1.0, 0.5)
    for power in (0.0, 0.5, 1.0):  # how the evidence of a text grows with its length
        for slope in 2.0 ** np.arange(-4, 7):
            level = -(bits - bits.min(axis=1, keepdims=True)) * (slope * np.power(np.maximum(n, 1), power))[:, None]
            level -= np.log(np.exp(np.maximum(level, -700)).sum(axis=1))[:, None]
            loss = -np.maximum(level[np.arange(len(truth)), truth], -50).mean() + 1e-4 * abs(np.log2(slope))
            best = min(best, (float(loss), float(slope), power))
    return Models(names, *tables, floor, limits, best[1], best[2])


def _of_texts(models: Models, texts: list[str | None], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """``Models.bits`` of texts, about ``most`` characters at a time; a longer text goes alone."""
    bits, sizes, start = [], [], 0
    while start < len(texts):
        end, total = start, 0
        while end < len(texts) and (end == start or total + len(texts[end] or "") <= most):
            total += len(texts[end] or "")
            end += 1
        part = models.bits(*letters(texts[start:end], models.order - 1))
        bits.append(part[0])
        sizes.append(part[1])
        start = end
    if not bits:
        return np.zeros((0, len(models.names))), np.zeros(0, np.int64)
    return np.concatenate(bits), np.concatenate(sizes)


def _sample(rows: DataFrame, train_rows: int, train_chars: int) -> DataFrame:
    """(text, lang) of distinct texts, the first of each language by hash, in a total order."""
    usable = rows.filter(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = usable.select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("n")).distinct().checkpoint()
    languages = max(1, known.select("lang").distinct().count())
    per, chars = max(3, train_rows // languages), train_chars // languages
    order = Window.partitionBy("lang").orderBy("h", "n")
    first = known.filter(F.col("n") <= chars).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per)
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))  # over at most ``per`` rows
    first = first.withColumn("upto", upto).filter(F.col("upto") <= chars).select("lang", "h", "n")
    keyed = usable.withColumns({"h": F.xxhash64("text"), "n": F.length("text")})
    picked = keyed.join(F.broadcast(first), ["lang", "h", "n"])  # at most train_rows rows, or 3 a language
    return picked.groupBy("lang", "h", "n").agg(F.min("text").alias("text")).select("lang", "text")


def language_scores(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = 5,
    train_rows: int = 6000,
    train_chars: int = 3_000_000,
    reject: bool = False,
) -> DataFrame:
    """(doc_id, lang_pred, score, bits, rejected), one row per input row.

    Learns one model per language from rows where ``learn`` holds and the language is not null:
    distinct texts, first by hash, ``train_rows`` rows and ``train_chars`` characters in all, shared
    by the languages (a longer single text is not learned from). Every whole text is scored.
    ``lang_pred`` has the fewest ``bits`` per character; ``score`` is its calibrated share, 0 to 1;
    ``rejected`` says that the bits exceed what held-back training texts of that language need. With
    ``reject`` such rows get ``und``. Null texts and texts without letters are ``und``, score 0, bits null; so are all rows if
    nothing could be learned. Ties go to the language that sorts first. Repeated rows are scored each; an
    empty table gives no rows; other columns are ignored.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = small_batches(docs).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    sample = _sample(rows, train_rows, train_chars).toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    texts, languages = sample["text"].to_pylist(), sample["lang"].to_pylist()
    mixed = np.random.default_rng(5).permutation(len(texts))
    model = train([texts[i] for i in mixed], [languages[i] for i in mixed], order) if len(mixed) else None
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            size = batch.num_rows
            names, share = [UNKNOWN] * size, np.zeros(size)
            least, worse = np.zeros(size), np.zeros(size, bool)
            some = np.zeros(size, bool)
            if model:
                bits, n = _of_texts(model, batch.column("text").to_pylist())
                best, share, worse = model.decide(bits, n)
                some, least = n > 0, bits[np.arange(size), best]
                names = [model.names[b] if s and not (reject and w) else UNKNOWN for b, s, w in zip(best, some, worse, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(names, pa.string()),
                    pa.array(np.where(some, share, 0.0)),
                    pa.array(least, mask=~some),
                    pa.array(worse & some),
                ],
                ["doc_id", "lang_pred", "score", "bits", "rejected"],
            )

    shape = "doc_id long, lang_pred string, score double, bits double, rejected boolean"
    return rows.select("id", "text").mapInArrow(run, shape)
