"""Many terms at once: an Aho-Corasick automaton finds all terms of a table in one pass of each text.

Column expressions read a text once per term, which suits a few words. Here the terms are a table.
They are taken in blocks of a bounded size (usually one); a block's automaton is built once, sent
to the executors, and run over Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions.arrays import empty_strings
from feedlens.functions.text import ascii_lower
from feedlens.operators.corpus import idf_value

#: Characters of the terms of a block.
BLOCK_CHARS = 4_000_000


def automaton(terms: list[str]):
    """Finds terms by their number; the empty term is left to ``found_terms``."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        if term:
            machine.add_word(term, number)
    machine.make_automaton()
    return machine


def found_terms(machine, empty: int | None, text: str | None) -> set[int]:
    """Numbers of the terms that a text contains; every text that is not empty contains the empty term."""
    if not text:
        return set()
    found = {number for _, number in machine.iter(text)} if len(machine) else set()
    if empty is not None:
        found.add(empty)
    return found


def term_blocks(terms: DataFrame, term_col: str, *more: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The distinct rows (term, ...) in blocks of about ``block_chars`` characters, each in term order."""
    rows = terms.filter(F.col(term_col).isNotNull()).select(term_col, *more).distinct()
    volume = rows.agg(F.sum(F.length(term_col) + 1)).first()[0] or 0
    blocks = max(1, -(-volume // block_chars))
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64(term_col), F.lit(blocks)) == block)
        held = sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0], str(r[1:])))
        if held:
            yield held


def _folded(corpus: DataFrame) -> DataFrame:
    """The searched texts of an article: three fields and the tags, in lower case."""
    tags = F.transform(F.coalesce("tags", empty_strings()), lambda t: F.lower(t))
    return corpus.select(F.array(*[F.lower(c) for c in ("title", "summary", "content")]).alias("fields"), tags.alias("tags"))


def document_frequencies(corpus: DataFrame, terms: DataFrame, term_col: str = "term", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(term, total_docs, doc_count, idf) for every distinct term of a table.

    An article holds a term that occurs in its title, summary, content or a tag, as in
    ``inverse_document_frequency``. Each batch counts its articles per term before the shuffle. Null terms
    are left out; the empty term occurs in every text that is not empty.
    """
    spark = corpus.sparkSession
    counted = []
    for block in term_blocks(terms, term_col, block_chars=block_chars):
        words = [term for (term,) in block]
        held = spark.sparkContext.broadcast((words, automaton(words)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            words, machine = held.value
            empty = words.index("") if words[0] == "" else None
            for batch in batches:
                counts: Counter[int] = Counter()
                for fields, tags in zip(batch.column("fields").to_pylist(), batch.column("tags").to_pylist(), strict=True):
                    found: set[int] = set()
                    for text in (*fields, *tags):
                        found |= found_terms(machine, empty, text)
                    if empty is not None and tags:
                        found.add(empty)  # an empty tag contains it, too
                    counts.update(found)
                numbers = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in numbers], pa.string()), pa.array([counts[i] for i in numbers], pa.int64())], ["term", "n"]
                )

        counted.append(_folded(corpus).mapInArrow(run, "term string, n long"))
    total = corpus.agg(F.count(F.lit(1)).alias("total_docs"))
    asked = terms.filter(F.col(term_col).isNotNull()).select(F.col(term_col).alias("term")).distinct()
    if not counted:
        return asked.select("term", *[F.lit(None).cast(t).alias(c) for c, t in (("total_docs", "long"), ("doc_count", "long"), ("idf", "double"))])
    found = reduce(DataFrame.union, counted).groupBy("term").agg(F.sum("n").alias("n"))
    known = asked.join(found, "term", "left").withColumn("total_docs", total.scalar())
    frequency = F.coalesce("n", F.lit(0))
    return known.select("term", "total_docs", frequency.alias("doc_count"), idf_value(F.col("total_docs"), frequency).alias("idf"))


def lexicon_table_relevance(
    articles: DataFrame,
    lexicon: DataFrame,
    word_col: str = "word",
    weight_col: str = "weight",
    name: str = "relevance",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Sets ``relevance`` by a lexicon of any size: ``lexicon_relevance`` without query and sources.

    A word counts 1.5 times its weight in the title, once in the content and 1.2 times per tag that
    equals it; the sum is at most 1. Of equal words the largest weight counts; null or empty words and null weights are left out.
    """
    usable = lexicon.filter((F.col(word_col) != "") & F.col(weight_col).isNotNull())
    words = usable.groupBy(word_col).agg(F.max(F.col(weight_col).cast("double")).alias("w"))
    out = articles.withColumn("_sum", F.lit(0.0))
    for block in term_blocks(words, word_col, "w", block_chars=block_chars):
        folded = [ascii_fold(word) for word, _ in block]
        numbers: dict[str, list[int]] = {}
        for i, word in enumerate(folded):
            numbers.setdefault(word, []).append(i)
        held = articles.sparkSession.sparkContext.broadcast((block, list(numbers.values()), automaton(list(numbers))))
        shape = out.schema

        def run(batches: Iterator[pa.RecordBatch], held=held, shape=shape) -> Iterator[pa.RecordBatch]:
            block, numbers, machine = held.value
            weights = [w for _, w in block]
            tag_weight = dict(block)
            for batch in batches:
                total = batch.column("_sum").to_pylist()
                columns = zip(batch.column("_title").to_pylist(), batch.column("_content").to_pylist(), batch.column("tags").to_pylist(), strict=True)
                for row, (title, content, tags) in enumerate(columns):
                    for text, factor in ((title, 1.5), (content, 1.0)):
                        for word in sorted(found_terms(machine, None, text)):
                            total[row] += sum(weights[i] for i in numbers[word]) * factor
                    total[row] += sum(tag_weight.get(t, 0.0) for t in tags or ()) * 1.2
                kept = [f.name for f in shape.fields if f.name != "_sum"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(total)], [*kept, "_sum"])

        order = [f.name for f in shape.fields if f.name != "_sum"]
        ready = out.withColumns({"_title": ascii_lower("title"), "_content": ascii_lower("content")})
        out = ready.mapInArrow(run, out.select(*order, "_sum").schema)
    return out.withColumn(name, F.least("_sum", F.lit(1.0))).drop("_sum")


def ascii_fold(word: str) -> str:
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in word)
