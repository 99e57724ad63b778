"""The corpus pipeline stage by stage, against brute force."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from feedlens.llm.secrets import secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_stages(spark, stages):
    raw, good, alone, clean, mix, coded = stages
    for df in stages[1:-1]:
        assert df.dtypes == raw.dtypes
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    marked = [r.doc_id for r in raw.collect() if r.doc_id in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in marked) > 0.9 * len(marked)

    texts = {r.doc_id: r.text for r in alone.collect()}
    assert set(texts) <= kept and len(set(texts.values())) == len(texts)
    found = {r.doc_id for r in secret_scan(alone).filter("size(filter(found, s -> s.verdict <> 'example')) > 0").collect()}
    for r in clean.collect():
        assert (r.text != texts[r.doc_id]) == (r.doc_id in found) and r.n_chars == len(r.text)
    copies = {}
    for r in mix.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= set(texts) and max(copies.values()) <= 3
    assert coded.count() == mix.count() and coded.filter("n_tokens <> size(ids)").count() == 0


def test_run_agrees(spark, stages):
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages[-1].collect())
    assert all(re.fullmatch("[0-9a-f]{64}", g[2]) for g in got)
