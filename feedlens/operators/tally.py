"""Counts of words within documents.

The words of a document never become rows of a shuffle or keys of a table in memory: rows are
dealt and sorted by id, so a task reads the texts of one id next to each other and counts them
before it goes on to the next. What a task holds is one batch of texts and the counts of one id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedlens import vocab
from feedlens.functions.terms import stem_word
from feedlens.functions.text import col

_OUT_ROWS = 1000

COUNTS = "array<struct<word: string, n: bigint>>"


def spaced(c: Column | str, pattern: str) -> Column:
    """Lower-case words with single spaces for the separators, as valid UTF-8."""
    return F.make_valid_utf8(F.regexp_replace(F.lower(col(c)), pattern, " "))


def by_document(docs: DataFrame, texts: Column, read: Callable[[Iterable], dict | None], returns: str) -> DataFrame:
    """(id, *returns): what ``read`` makes of the ``texts`` values of all rows of an id, in any order.

    An id for which ``read`` returns None has no row. Rows without an id are read as one document.
    """
    schema = StructType([docs.schema["id"], *StructType.fromDDL(returns)])

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rows = ((i, t) for b in given for i, t in zip(b.column(0).to_pylist(), _values(b.column(1))))
        out = []
        for key, group in groupby(rows, itemgetter(0)):
            made = read(t for _, t in group)
            if made is not None:
                out.append({"id": key, **made})
            if len(out) >= _OUT_ROWS:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, arrow)

    return docs.select("id", texts.alias("_texts")).mapInArrow(batches, schema)


def _values(array: pa.Array) -> Iterator:
    """The values of a column, made one at a time."""
    return (x.as_py() for x in array)


def in_id_order(docs: DataFrame) -> DataFrame:
    return docs.repartition("id").sortWithinPartitions("id")


_STOP_WORDS = frozenset(vocab.SUMMARY_STOP_WORDS)
_TERM_STOP_WORDS = frozenset(vocab.TERM_STOP_WORDS)


def _bare_uses(raw: Counter) -> Counter:
    """Uses of the words that can be keywords, without their outer punctuation."""
    out = Counter()
    for word, n in raw.items():
        bare = word.strip(vocab.WORD_TRIM_CHARS)
        if len(bare.encode()) >= 3 and bare not in _STOP_WORDS:
            out[bare] += n
    return out


def _keywords(uses: Counter) -> dict[str, int]:
    """Words that repeat, or have more than six bytes."""
    return {word: n for word, n in uses.items() if n > 1 or len(word.encode()) > 6}


def read_keywords(texts: Iterable[str | None]) -> dict | None:
    """The keywords of lower-case texts with their uses (see ``COUNTS``)."""
    raw = Counter()
    for text in texts:
        raw.update((text or "").split(" "))
    found = _keywords(_bare_uses(raw))
    return {"words": [{"word": w, "n": n} for w, n in found.items()]} if found else None


def read_terms(fields: Iterable[list[dict]]) -> dict | None:
    """The stems of lower-case fields (w, t), each use counted with the weight ``w`` of its field."""
    raw = Counter()
    for row in fields:
        for field in row:
            for word, n in Counter((field["t"] or "").split(" ")).items():
                raw[word] += n * field["w"]
    out = Counter()
    for word, n in raw.items():
        out[stem_word(word)] += n
    kept = [{"word": w, "n": n} for w, n in out.items() if len(w.encode()) > 2 and w not in _TERM_STOP_WORDS]
    return {"words": kept} if kept else None


SENTENCES = "has_keywords boolean, sentences array<struct<place: int, length: int, hits: bigint, total: bigint>>"


def read_sentences(texts: Iterable[dict]) -> dict | None:
    """Words and keywords among them in each sentence of lower-case texts (whole, parts)."""
    raw, places = Counter(), {}
    for text in texts:
        raw.update((text["whole"] or "").split(" "))
        for part in text["parts"] or ():
            kept = places.setdefault(part["place"], [0, Counter()])
            kept[0] = max(kept[0], part["length"])
            kept[1].update(w for w in part["text"].split(" ") if w)
    found = _keywords(_bare_uses(raw))
    sentences = [
        {
            "place": place,
            "length": length,
            "hits": sum(n for word, n in uses.items() if word in found),
            "total": uses.total(),
        }
        for place, (length, uses) in places.items()
        if uses
    ]
    return {"has_keywords": bool(found), "sentences": sentences} if sentences else None
