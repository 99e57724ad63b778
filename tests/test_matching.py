"""The automaton against the ``contains`` form."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from feedlens.operators.corpus import inverse_document_frequency
from feedlens.operators.lexicon import lexicon_relevance
from feedlens.operators.matching import document_frequencies, lexicon_table_relevance
from test_articles import articles


def _random(spark, seed):
    draw = random.Random(seed)
    letters = "abcÄé日 "
    text = lambda n: "".join(draw.choice(letters) for _ in range(draw.randrange(n)))
    rows = articles(spark, [dict(id=str(i), title=text(9), summary=text(20), content=text(90), tags=[text(4) for _ in range(i % 3)]) for i in range(60)])
    terms = [w.lower() for w in {text(4) for _ in range(60)} | {"", "a", "日", "never there"}]
    return rows, list(dict.fromkeys(terms))


@pytest.mark.parametrize("block_chars", [10**6, 12])
def test_frequencies_equal_contains(spark, block_chars):
    rows, terms = _random(spark, 6)
    table = spark.createDataFrame([(t, 1) for t in terms] + [(None, 1), ("a", 2)], "term string, n int")
    got = {r.term: tuple(r) for r in document_frequencies(rows, table, block_chars=block_chars).collect()}
    want = {r.term: tuple(r) for r in inverse_document_frequency(rows, terms).collect()}
    assert got.keys() == want.keys()
    for term, row in want.items():
        assert got[term][:3] == row[:3] and got[term][3] == pytest.approx(row[3])


@pytest.mark.parametrize("block_chars", [10**6, 12])
def test_lexicon_equals_contains(spark, block_chars):
    rows, terms = _random(spark, 7)
    lexicon = {t: 0.001 * (i % 9 + 1) for i, t in enumerate(t for t in terms if t)}
    table = spark.createDataFrame([*lexicon.items(), ("", 5.0), (None, 5.0), ("x", None)], "word string, weight double")
    got = lexicon_table_relevance(rows, table, block_chars=block_chars)
    assert got.columns == rows.columns
    want = {r.id: r.relevance for r in lexicon_relevance(rows, "", lexicon, {}).collect()}
    assert {r.id: pytest.approx(r.relevance) for r in got.collect()} == want


def test_no_terms_and_no_rows(spark):
    rows, terms = _random(spark, 8)
    table = spark.createDataFrame([(t, 1.0) for t in terms], "word string, weight double")
    assert document_frequencies(rows, table.limit(0), "word").count() == 0
    empty = document_frequencies(rows.limit(0), table, "word").agg(F.max("doc_count"), F.max("idf"), F.count("*")).first()
    assert tuple(empty) == (0, 0.0, len(terms))
    assert {r.relevance for r in lexicon_table_relevance(rows, table.limit(0)).collect()} == {0.0}
