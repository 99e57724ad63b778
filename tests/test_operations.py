from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedlens.operators import accesslog, greedy, requests, retention
from feedlens.operators.sequence import with_following, with_position, with_running_sum
from feedlens.schemas import ACCESS_LOG, INVENTORY
from feedlens.session import ensure_checkpoint_dir

T0 = datetime(2024, 1, 1)


def log(spark, rows):
    base = dict(seq=0, ts=T0, op="get", key="k", hit=True, duration_ms=1.0, size_bytes=0, data_type="t", error=None)
    full = [{**base, "seq": i, "ts": T0 + timedelta(seconds=i), **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in ACCESS_LOG) for r in full], ACCESS_LOG)


def test_latency(spark):
    rows = log(spark, [dict(duration_ms=float(d)) for d in (10, 20, 50, 100, 200)])
    got = accesslog.latency_stats(rows).first()
    assert (got["count"], got.average_ms, got.min_ms, got.max_ms, got.p50_ms) == (5, 76.0, 10.0, 200.0, 50.0)
    # a zero clears the minimum
    rows = log(spark, [dict(duration_ms=float(d)) for d in (5, 0, 7, 9)])
    assert accesslog.latency_stats(rows).first().min_ms == 7.0
    # percentiles see the last 1000 rows only
    rows = log(spark, [dict(duration_ms=1000.0)] * 500 + [dict(duration_ms=1.0)] * 1000)
    got = accesslog.latency_stats(rows).first()
    assert (got.p99_ms, got.max_ms, got["count"]) == (1.0, 1000.0, 1500)


def test_memory_never_negative(spark):
    moves = [("set", 10), ("delete", 30), ("set", 5), ("evict", 2), ("set", 7), ("delete", 0)]
    rows = log(spark, [dict(op=o, size_bytes=s) for o, s in moves])
    assert [r.level for r in accesslog.memory_levels(rows).orderBy("seq").collect()] == [10, 0, 5, 3, 10]
    got = accesslog.memory_usage(rows, 100).first()
    assert (got.current_size_bytes, got.peak_size_bytes, got.usage_percent, got.net_allocations) == (10, 10, 10.0, 1)


def test_counts_and_health(spark):
    rows = log(spark, [dict(hit=False), dict(), dict(op="error", error="x"), dict(op="set", size_bytes=2_000_000, duration_ms=150.0)])
    got = accesslog.operation_counts(rows).first()
    assert (got.hits, got.misses, got.sets, got.hit_rate) == (1, 1, 1, 50.0)
    stats = accesslog.detailed_stats(rows, 1000).first()
    assert stats.latency["set"].max_ms == 150.0 and stats.large_items == 1 and stats.slow_operations == 1 and stats.last_error == "x"
    table = spark.createDataFrame([(10.0, 96.0, 101, 51), (90.0, 10.0, 0, 0)], "hit_rate double, memory_percent double, error_count long, slow_operations long")
    assert [r.status for r in accesslog.health_status(table).collect()] == ["critical", "healthy"]
    alerts = [r.level for r in accesslog.threshold_alerts(table).collect()]
    assert alerts == ["warning", "critical", "error", "warning"]


def test_top_keys_restart_after_delete(spark):
    rows = log(spark, [dict(key="a"), dict(key="a"), dict(key="b"), dict(key="a", op="delete"), dict(key="a")])
    assert [tuple(r) for r in accesslog.top_keys(rows).collect()] == [("a", 1), ("b", 1)]


def random_times(n, seed):
    rng, now, out = random.Random(seed), 0, []
    for i in range(n):
        now += rng.choice([1, 20, 60, 200, 400, 3000])
        out.append((f"k{rng.randrange(3)}", T0 + timedelta(seconds=now), i, float(rng.choice([0, 5, 40, 900])) * 1000))
    return out


@pytest.mark.parametrize("scan_rows", [0, 20, greedy.SCAN_ROWS])
def test_suppression_matches_brute_force(spark, scan_rows):
    rows = random_times(600, 1) + [(None, T0 + timedelta(seconds=97 * i), 1000 + i, 1.0) for i in range(40)]
    rows += [("twins", T0, 2000 + i, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "alert_key string, ts timestamp_ntz, seq long, duration_ms double").repartition(5)
    got = sorted(r.seq for r in greedy.suppress_repeats(df, scan_rows=scan_rows).collect())
    sent, want = {}, []
    for key, ts, seq, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in sent or ts - sent[key] >= timedelta(minutes=5):
            sent[key] = ts
            want.append(seq)
    assert got == sorted(want) and len(want) < len(rows)


@pytest.mark.parametrize("scan_rows", [0, 20, greedy.SCAN_ROWS])
def test_merging_matches_brute_force(spark, scan_rows):
    rows = random_times(600, 2) + [("twins", T0 + timedelta(seconds=i // 4), 1000 + i, float(i % 3 * 900)) for i in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "key string, ts timestamp_ntz, seq long, duration_ms double, k string").repartition(5)
    merged = greedy.merge_requests(df, scan_rows=scan_rows)
    got = {r.seq for r in merged.where("merged").collect()}
    leader, want = {}, set()
    for key, ts, seq, ms in sorted(rows, key=lambda r: (r[1], r[2])):
        if key in leader:
            since = ts - leader[key][0]
            if since <= timedelta(seconds=30) and since < timedelta(milliseconds=leader[key][1]):
                want.add(seq)
                continue
        leader[key] = (ts, ms)
    assert got == want and want
    saved = greedy.merge_savings(merged).first()
    assert (saved.total_requests, saved.saved_queries) == (640, len(want))


def test_greedy_scans_of_nothing(spark):
    empty = spark.createDataFrame([], "alert_key string, key string, ts timestamp_ntz, seq long, duration_ms double")
    assert greedy.suppress_repeats(empty).count() == greedy.merge_requests(empty, scan_rows=0).count() == 0


def test_a_busy_key_is_spread(spark):
    """A key without a quiet spell: its rows lie in many parts, and the chain is right across them."""
    rows = spark.range(30_000).select(F.lit("hot").alias("alert_key"), F.timestamp_micros(F.col("id") * 1_000_003).alias("ts"), F.col("id").alias("seq"))
    got = sorted(r.seq for r in greedy.suppress_repeats(rows, quiet=timedelta(seconds=100), scan_rows=1000).collect())
    want, sent = [], None
    for i in range(30_000):
        if sent is None or (i - sent) * 1_000_003 >= 100_000_000:
            sent = i
            want.append(i)
    assert got == want


def test_following_values(spark):
    rng = random.Random(4)
    rows = [(i, "ab"[rng.randrange(2)], rng.choice([None, rng.randrange(99)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(6)
    got = {r.id: r.x for r in with_following(df, [F.col("k"), F.col("id")], "k", F.col("v"), "x").collect()}
    for i, k, _ in rows:
        assert got[i] == next((v for j, c, v in rows[i + 1 :] if c == k and v is not None), None)


def test_positions_and_running_sums(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5), rng.randrange(-9, 10)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(7)
    order = [F.col("k").desc(), F.col("id").asc()]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = with_position(df, order).orderBy("position").collect()
    assert [(r.id, r.position) for r in got] == [(r[0], i + 1) for i, r in enumerate(want)]
    got = with_running_sum(df, order, F.col("v"), "s").orderBy(*order).collect()
    total, low = 0, 10**9
    for r, w in zip(got, want):
        total += w[2]
        low = min(low, total)
        assert (r.s, r.s_min) == (total, low)


def entries(spark, rows):
    base = dict(key="k", size_bytes=0, access_count=0, last_accessed=T0, created_at=T0, expiry=T0 + timedelta(hours=1))
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in INVENTORY) for r in rows], INVENTORY)


def test_cleanup(spark):
    now = T0 + timedelta(hours=3)
    live = dict(key="live", size_bytes=102400, access_count=5, last_accessed=now - timedelta(hours=1), expiry=now + timedelta(hours=1))
    gone = dict(key="gone", size_bytes=1024, access_count=1, last_accessed=now - timedelta(hours=1), expiry=now - timedelta(minutes=30))
    fresh = dict(key="fresh", size_bytes=10, last_accessed=now, expiry=now + timedelta(hours=1))
    rows = entries(spark, [live, gone, fresh])
    priority = {r.key: r.p for r in rows.select("key", retention.cleanup_priority(now).alias("p")).collect()}
    assert priority == {"live": 1, "gone": 999, "fresh": 0}
    assert [r.key for r in retention.select_for_cleanup(rows, now).collect()] == ["gone"]
    assert {r.key for r in rows.where(retention.should_clean("lru", now)).collect()} == {"live", "gone"}
    assert retention.predict_cleanup(rows.where("false"), now).first().cleanup_percentage is None
    with pytest.raises(ValueError):
        retention.should_clean("other", now)


@pytest.mark.parametrize(("parity", "expected"), [(True, 2), (False, 4)])
def test_eviction(spark, parity, expected):
    rows = entries(spark, [dict(key=f"k{i}", size_bytes=10, last_accessed=T0 + timedelta(minutes=i)) for i in range(6)])
    evicted = retention.lru_eviction_set(rows, needed=10, max_bytes=30, parity=parity).orderBy("key").collect()
    assert [r.key for r in evicted] == [f"k{i}" for i in range(expected)]


def test_ttl(spark):
    writes = spark.createDataFrame([("a", T0, 0, 1), ("a", T0 + timedelta(minutes=1), 10**9, 2), ("b", T0, 5, 3)], "key string, ts timestamp_ntz, ttl_ms long, seq long")
    got = {r.key: r for r in retention.assign_ttl(writes).collect()}
    assert got["a"].ttl_ms == 86_400_000 and got["b"].ttl_ms == 60_000 and got["b"].expiry == T0 + timedelta(minutes=1)
    asked = spark.createDataFrame([("a", 10**9), ("b", 1), ("c", 1)], "key string, add_ms long")
    got = {r.key: r for r in retention.extend_ttl(retention.assign_ttl(writes), asked, T0 + timedelta(minutes=5)).collect()}
    assert got["a"].ttl_ms == 86_400_000 and got["b"].error == "key has expired" and got["c"].error == "key not found"
    runs = log(spark, [dict(duration_ms=float(d)) for d in (8, 4, 2)])
    assert retention.average_cleanup_ms(runs).first()[0] == ((8 + 4) / 2 + 2) / 2


def test_requests(spark):
    df = spark.createDataFrame([("2024-02-30", "2024/01/01", "x&y")], "start_date string, end_date string, query string")
    checked = df.select("*", F.array_compact(F.array(*requests.date_errors(T0))).alias("errors")).first()
    assert [e.code for e in checked.errors] == ["DATE_PARSE_ERROR", "INVALID_DATE_FORMAT"]
    got = requests.sanitize_queries(spark.createDataFrame([("next.js\x00",), ("a<b",)], "query string")).collect()
    assert got[0].clean_query == "next.js" and got[1].query_problem and got[1].clean_query == ""
    assert spark.range(1).select(requests.sanitize(F.lit("<'"))).first()[0] == "&amp;lt;&amp;#x27;"


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder and folder == spark.sparkContext.getCheckpointDir()
