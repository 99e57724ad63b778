from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedlens.operators import greedy
from feedlens.sources import feeds
from feedlens.streaming import ingest, ledger, monitor
from feedlens.streaming.run import drain
from test_sources import RSS, payload

T0 = datetime(2024, 1, 1)


def test_payload_stream_equals_batch(spark, tmp_path):
    landed = payload(spark, "http://e.com/rss", RSS)
    landed.write.parquet(str(tmp_path / "in"))
    rows = drain(ingest.parse_stream(ingest.payload_stream(spark, str(tmp_path / "in")), feeds.parse_rss))
    assert sorted(map(str, rows.collect())) == sorted(map(str, feeds.parse_rss(landed).collect()))


def _stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_suppression_stream_equals_batch(spark, tmp_path):
    """Shuffled within the delay and over several files; state ends once a key is quiet."""
    schema = "alert_key string, ts timestamp, seq long"
    rows = [("ab"[i % 3 > 0], T0 + timedelta(seconds=70 * i), i) for i in range(80)]
    rows += [("old", T0 + timedelta(seconds=20 * i), 100 + i) for i in range(6)]
    draw = random.Random(2)
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(seconds=draw.randrange(500)))
    path = str(tmp_path / "in")
    for k in range(4):
        part = arrival[k * 22 : (k + 1) * 22]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    (tmp_path / "out").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        monitor.suppress_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        .option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = max(r[1] for r in rows) - timedelta(minutes=10)
    batch = greedy.suppress_repeats(spark.createDataFrame([r for r in rows if r[1] < last], schema))
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r.seq for r in batch.collect())
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) == 3 and kept[-1] == 2  # "old" is forgotten


def test_expiry_stream(spark, tmp_path):
    rows = [("a", T0, 60_000), ("a", T0 + timedelta(minutes=1), 60_000), ("b", T0, 86_400_000), ("c", T0 + timedelta(hours=2), 60_000)]
    stream = _stream(spark, str(tmp_path / "in"), rows, "key string, ts timestamp, ttl_ms long")
    got = drain(monitor.expiry_stream(stream)).select("key", F.timestamp_micros("expired_at_us").cast("string").alias("t")).collect()
    assert [tuple(r) for r in got] == [("a", "2024-01-01 00:02:00")]


def test_dedup_stream(spark, tmp_path):
    rows = [("T", "u", T0), ("t", "u", T0), ("x", "u", T0)]
    stream = _stream(spark, str(tmp_path / "in"), rows, "title string, url string, published_at timestamp")
    assert drain(ingest.dedup_stream(stream)).count() == 2


def test_ledger_acts_once_per_batch(spark, tmp_path):
    """A replayed batch changes nothing; an unfinished one is replaced and acted on again."""
    acted = []
    book = ledger.BatchLedger(spark, str(tmp_path / "ledger"))
    assert book.rows("k string").count() == 0 and not book.is_done(0)

    def action(rows, batch_id):
        acted.append((batch_id, sorted(r.k for r in rows.collect())))
        if len(acted) == 2:
            raise RuntimeError("mail server gone")

    one = spark.createDataFrame([("a",), ("b",)], "k string")
    book.apply(one, 0, action)
    book.apply(one, 0, action)
    with pytest.raises(RuntimeError):
        book.apply(one.filter("k = 'a'"), 1, action)
    assert book.done().count() == 1 and book.rows("k string").count() == 2
    book.apply(one.filter("k = 'b'"), 1, action)
    assert acted == [(0, ["a", "b"]), (1, ["a"]), (1, ["b"])]
    assert sorted((r.batch_id, r.k) for r in book.rows("k string").collect()) == [(0, "a"), (0, "b"), (1, "b")]
    assert sorted(map(tuple, book.done().collect())) == [(0, 2), (1, 1)]


def test_ledger_of_a_stream(spark, tmp_path):
    """The stream stops after its ledger was written but before Spark noted the batch: the replay skips it."""
    path = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(f"k{k}",)], "k string").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema("k string").option("maxFilesPerTrigger", 1).parquet(path)
    sent = []
    book = ledger.BatchLedger(spark, str(tmp_path / "ledger"))
    run = lambda state: ledger.on_each_batch(stream(), book, str(tmp_path / state), lambda rows, i: sent.append((i, rows.count())), availableNow=True).awaitTermination()
    run("state")
    assert sent == [(0, 1), (1, 1), (2, 1)]
    run("lost")  # without Spark's own notes every batch comes again
    assert len(sent) == 3 and book.rows("k string").count() == 3
