"""The data source for landing folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from feedlens.sources import registry
from feedlens.sources.feeds import parse_rss
from feedlens.sources.landed import BATCH_ROWS, LandedPayloads
from feedlens.streaming.run import drain
from test_sources import RSS

PAGE = "<html><title>T{}</title><article>Text {}</article></html>"


def _parquet(spark, path, start, n, mode="append"):
    rows = [(f"http://e.com/{i}", PAGE.format(i, i), i) for i in range(start, start + n)]
    spark.createDataFrame(rows, "u string, html string, k long").coalesce(1).write.mode(mode).parquet(path)


def test_batch_equals_payload_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    _parquet(spark, path, 0, BATCH_ROWS + 30)
    _parquet(spark, path, 5000, 20)
    (tmp_path / "in" / "_unfinished.parquet").write_bytes(b"no parquet")
    options = dict(url="u", body="html", seq="k", tags="a,b", language="en", fetched_at="2024-01-01T00:00:00", metadata='{"team": "x"}')
    registry.register_connector(spark, LandedPayloads)
    landed = spark.read.format("landed_payloads").options(**options).load(path)
    assert landed.rdd.getNumPartitions() == 2
    got = landed.select("payload_seq", "source_url", "body", "config_tags", "config_language", "config_metadata", F.col("fetched_at").cast("string").alias("t"))
    want = {(i, f"http://e.com/{i}", PAGE.format(i, i)) for i in [*range(BATCH_ROWS + 30), *range(5000, 5020)]}
    rows = got.collect()
    assert {tuple(r)[:3] for r in rows} == want and len(rows) == len(want)
    assert {(tuple(r.config_tags), r.config_language, str(r.config_metadata), r.t) for r in rows} == {(("a", "b"), "en", "{'team': 'x'}", "2024-01-01 00:00:00")}
    parsed = registry.read_landed(spark, path, **options)
    assert sorted(map(str, parsed.collect())) == sorted(map(str, registry.parse_payloads(landed).collect()))
    assert parsed.count() == len(want)


def test_json_lines_and_nulls(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in [{"url": "http://e.com/rss", "body": RSS, "extra": 1}, {"url": "http://e.com/feed", "body": None}]))
    (tmp_path / "empty.jsonl").write_text("")
    rows = registry.read_landed(spark, str(tmp_path))
    landed = spark.read.format("landed_payloads").load(str(tmp_path))
    assert landed.count() == 2 and landed.filter("payload_seq IS NULL AND fetched_at IS NULL").count() == 2
    assert rows.select("title").distinct().count() == parse_rss(landed).select("title").distinct().count() > 0


def test_stream_follows_the_folder(spark, tmp_path):
    path = str(tmp_path / "in")
    options = dict(url="u", body="html", seq="k")
    _parquet(spark, path, 0, 10)
    state = str(tmp_path / "state")

    def run():
        registry.register_connector(spark, LandedPayloads)
        stream = registry.read_landed(spark, path, stream=True, **options)
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", str(tmp_path / "out"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted(r.ingest_seq for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [i * 1_000_000 for i in range(10)]
    _parquet(spark, path, 10, 5)
    assert run() == [i * 1_000_000 for i in range(15)]  # only the new file is read again
    batch = registry.read_landed(spark, path, **options)
    assert drain(registry.read_landed(spark, path, stream=True, **options)).count() == batch.count() == 15


def test_missing_folder(spark):
    with pytest.raises(Exception, match="no landing folder"):
        registry.read_landed(spark, "/nowhere/at/all").count()
