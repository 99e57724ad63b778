"""Access-log, retention and request-log queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from feedlens.functions.identity import query_fingerprint
from feedlens.operators import accesslog, greedy, reports, retention
from feedlens.workload import bindings as b
from feedlens.workload.registry import query

LOG = b.views("access_log")
MAX = 512 * 1024 * 1024


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_HIT_RATE = "round(count(*) FILTER (WHERE op = 'get' AND hit) * 100e0 / count(*) FILTER (WHERE op = 'get'), 6)"


@query(
    "operation_counts",
    LOG
    + f"""SELECT count(*) FILTER (WHERE op = 'get' AND hit) AS hits, count(*) FILTER (WHERE op = 'get' AND NOT hit) AS misses,
          count(*) FILTER (WHERE op = 'set') AS sets, count(*) FILTER (WHERE op = 'delete') AS deletes,
          count(*) FILTER (WHERE op = 'evict') AS evictions, {_HIT_RATE} AS hit_rate,
          round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(min(ts))) / 1e6, 6) AS uptime_seconds FROM access_log""",
)
def _counts(spark, sf_dir):
    return _rounded(accesslog.operation_counts(b.access_log(spark, sf_dir), b.AS_OF), "hit_rate", "uptime_seconds")


_LATENCY = """
n AS (SELECT op, ts, seq, CAST(round(duration_ms * 1000000) AS BIGINT) AS ns FROM access_log WHERE op IN ('get', 'set', 'delete')),
tot AS (SELECT op, count(*) AS count, sum(ns) // count(*) AS avg_ns, min(ns) AS lo, max(ns) AS hi FROM n GROUP BY op),
recent AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY op ORDER BY ts DESC, seq DESC) <= 1000),
ranked AS (SELECT op, ns, row_number() OVER (PARTITION BY op ORDER BY ns) - 1 AS i, count(*) OVER (PARTITION BY op) AS k FROM recent),
pct AS (SELECT op, max(ns) FILTER (WHERE i = k * 50 // 100) AS p50, max(ns) FILTER (WHERE i = k * 95 // 100) AS p95,
        max(ns) FILTER (WHERE i = k * 99 // 100) AS p99 FROM ranked GROUP BY op)"""


@query(
    "latency_stats",
    b.views("access_log", more=_LATENCY)
    + """SELECT op, count, round(avg_ns / 1e6, 6) AS average_ms, lo / 1e6 AS min_ms, hi / 1e6 AS max_ms,
         p50 / 1e6 AS p50_ms, p95 / 1e6 AS p95_ms, p99 / 1e6 AS p99_ms FROM tot JOIN pct USING (op)""",
)
def _latency(spark, sf_dir):
    return _rounded(accesslog.latency_stats(b.access_log(spark, sf_dir)), "average_ms")


_MEMORY = """
moves AS (SELECT seq, ts, op, CASE WHEN op = 'set' THEN size_bytes ELSE -size_bytes END AS delta FROM access_log
          WHERE op = 'set' OR (op = 'delete' AND size_bytes > 0)),
sums AS (SELECT *, sum(delta) OVER (ORDER BY ts, seq) AS c FROM moves),
lows AS (SELECT *, least(0, min(c) OVER (ORDER BY ts, seq)) AS low FROM sums),
levels AS (SELECT seq, ts, op, CAST(c - low AS BIGINT) AS level FROM lows)"""


@query("memory_levels", b.views("access_log", more=_MEMORY) + "SELECT seq, op, level FROM levels")
def _levels(spark, sf_dir):
    return accesslog.memory_levels(b.access_log(spark, sf_dir)).select("seq", "op", "level")


@query(
    "memory_usage",
    b.views("access_log", more=_MEMORY)
    + f"""SELECT arg_max(level, (ts, seq)) AS current_size_bytes, max(level) FILTER (WHERE op = 'set') AS peak_size_bytes,
          count(*) FILTER (WHERE op = 'set') AS total_allocations, count(*) FILTER (WHERE op <> 'set') AS total_deallocations,
          CAST({MAX} AS BIGINT) AS max_size_bytes, round(arg_max(level, (ts, seq)) * 100e0 / {MAX}, 6) AS usage_percent,
          round(max(level) FILTER (WHERE op = 'set') * 100e0 / {MAX}, 6) AS peak_usage_percent,
          count(*) FILTER (WHERE op = 'set') - count(*) FILTER (WHERE op <> 'set') AS net_allocations FROM levels""",
)
def _memory(spark, sf_dir):
    return _rounded(accesslog.memory_usage(b.access_log(spark, sf_dir), MAX), "usage_percent", "peak_usage_percent")


@query(
    "memory_history",
    b.views("access_log", more=_MEMORY) + "SELECT seq, level FROM levels ORDER BY ts DESC, seq DESC LIMIT 100",
)
def _history(spark, sf_dir):
    return accesslog.memory_history(b.access_log(spark, sf_dir)).select("seq", "level")


@query(
    "top_keys",
    LOG
    + """SELECT key, count(*) AS count FROM access_log l WHERE op = 'get' AND NOT EXISTS (
           SELECT 1 FROM access_log d WHERE d.op = 'delete' AND d.key = l.key AND (d.ts, d.seq) > (l.ts, l.seq))
         GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _top_keys(spark, sf_dir):
    return accesslog.top_keys(b.access_log(spark, sf_dir))


@query(
    "hourly_hits",
    LOG + "SELECT hour(ts) AS hour, count(*) AS hits FROM access_log WHERE op = 'get' AND hit GROUP BY 1",
)
def _hourly(spark, sf_dir):
    return accesslog.hourly_hits(b.access_log(spark, sf_dir))


@query(
    "type_distribution",
    LOG + "SELECT data_type, count(*) AS sets FROM access_log WHERE op = 'set' GROUP BY 1",
)
def _types(spark, sf_dir):
    return accesslog.type_distribution(b.access_log(spark, sf_dir))


@query(
    "size_distribution",
    LOG
    + """SELECT CASE WHEN size_bytes <= 1024 THEN '<=1KB' WHEN size_bytes <= 10240 THEN '<=10KB' WHEN size_bytes <= 102400 THEN '<=100KB'
         WHEN size_bytes <= 1048576 THEN '<=1MB' WHEN size_bytes <= 10485760 THEN '<=10MB' ELSE '>10MB' END AS size_class,
         count(*) AS uses FROM access_log WHERE op IN ('get', 'set') GROUP BY 1""",
)
def _sizes(spark, sf_dir):
    return accesslog.size_distribution(b.access_log(spark, sf_dir))


@query(
    "slow_and_large",
    LOG
    + """SELECT count(*) FILTER (WHERE op <> 'error' AND duration_ms > 100) AS slow_operations,
         count(*) FILTER (WHERE op IN ('get', 'set') AND size_bytes > 1048576) AS large_items FROM access_log""",
)
def _slow(spark, sf_dir):
    return accesslog.slow_and_large(b.access_log(spark, sf_dir))


@query(
    "error_summary",
    LOG
    + """SELECT count(*) AS error_count, arg_max(error, (ts, seq)) AS last_error, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_error_time
         FROM access_log WHERE op = 'error'""",
)
def _errors(spark, sf_dir):
    rows = accesslog.error_summary(b.access_log(spark, sf_dir))
    return rows.withColumn("last_error_time", F.date_format("last_error_time", "yyyy-MM-dd HH:mm:ss"))


@query(
    "detailed_stats",
    b.views("access_log", more=f"{_LATENCY},{_MEMORY}")
    + f"""SELECT (SELECT count(*) FROM access_log WHERE op = 'get' AND hit) AS hits, (SELECT {_HIT_RATE} FROM access_log) AS hit_rate,
          (SELECT p95 / 1e6 FROM pct WHERE op = 'get') AS get_p95, (SELECT hi / 1e6 FROM tot WHERE op = 'set') AS set_max,
          (SELECT max(level) FROM levels WHERE op = 'set') AS peak, (SELECT count(*) FROM access_log WHERE op = 'error') AS error_count""",
)
def _detailed(spark, sf_dir):
    stats = accesslog.detailed_stats(b.access_log(spark, sf_dir), MAX)
    return stats.select(
        "hits", F.round("hit_rate", 6).alias("hit_rate"), F.col("latency")["get"]["p95_ms"].alias("get_p95"),
        F.col("latency")["set"]["max_ms"].alias("set_max"), F.col("memory.peak_size_bytes").alias("peak"), "error_count",
    )


_REPORT = """
rep AS (
  SELECT date_trunc('hour', ts) AS w, count(*) FILTER (WHERE op = 'get' AND hit) AS hits, count(*) FILTER (WHERE op = 'get' AND NOT hit) AS misses,
    count(*) FILTER (WHERE op = 'set') AS sets, count(*) FILTER (WHERE op = 'delete') AS deletes,
    CASE WHEN count(*) FILTER (WHERE op = 'get') = 0 THEN 0e0 ELSE count(*) FILTER (WHERE op = 'get' AND hit) * 100e0 / count(*) FILTER (WHERE op = 'get') END AS hit_rate,
    count(*) FILTER (WHERE op <> 'error' AND duration_ms > 100) AS slow_operations, count(*) FILTER (WHERE op = 'error') AS error_count
  FROM access_log GROUP BY 1
)"""

#: Bytes that count as full in the hourly reports, so that the given log reaches the limits.
HOURLY_MAX = 256 * 1024 * 1024
_WITH_MEMORY = (
    _REPORT.replace("rep AS", "plain AS", 1)
    + f""",{_MEMORY},
ends AS (SELECT date_trunc('hour', ts) AS w, arg_max(level, (ts, seq)) AS level FROM levels GROUP BY 1),
rep AS (
  SELECT plain.*, coalesce(last_value(level IGNORE NULLS) OVER (ORDER BY w), 0) / {HOURLY_MAX}e0 * 100 AS memory_percent
  FROM plain LEFT JOIN ends USING (w))"""
)


def _hourly_stats(spark, sf_dir):
    log = b.access_log(spark, sf_dir)
    return accesslog.periodic_report(log, "1 hour").join(accesslog.memory_by_interval(log, HOURLY_MAX), "window_start")


@query(
    "memory_by_interval",
    b.views("access_log", more=_WITH_MEMORY) + "SELECT strftime(w, '%Y-%m-%d %H') AS hour, round(memory_percent, 6) AS memory_percent FROM rep",
)
def _memory_hours(spark, sf_dir):
    rows = accesslog.memory_by_interval(b.access_log(spark, sf_dir), HOURLY_MAX)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), F.round("memory_percent", 6).alias("memory_percent"))


@query(
    "periodic_report",
    b.views("access_log", more=_REPORT.replace("'hour'", "'minute'"))
    + """SELECT strftime(w, '%Y-%m-%d %H:%M') AS minute, hits, misses, sets, deletes, round(hit_rate, 6) AS hit_rate, slow_operations, error_count FROM rep""",
)
def _periodic(spark, sf_dir):
    rows = accesslog.periodic_report(b.access_log(spark, sf_dir))
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "hits", "misses", "sets", "deletes",
        F.round("hit_rate", 6).alias("hit_rate"), "slow_operations", "error_count",
    )


@query(
    "health_status",
    b.views("access_log", more=_WITH_MEMORY)
    + """SELECT strftime(w, '%Y-%m-%d %H') AS hour, CASE WHEN memory_percent > 95 THEN 'critical' WHEN hit_rate < 20 THEN 'degraded' ELSE 'healthy' END AS status,
         array_to_string(list_filter([CASE WHEN hit_rate < 50 THEN printf('低命中率: %.2f%%', hit_rate) END,
           CASE WHEN memory_percent > 80 THEN printf('高内存使用率: %.2f%%', memory_percent) END,
           CASE WHEN error_count > 0 THEN '发现 ' || error_count || ' 个错误' END,
           CASE WHEN slow_operations > 0 THEN '发现 ' || slow_operations || ' 个慢操作' END], lambda x: x IS NOT NULL), '; ') AS warnings,
         CASE WHEN memory_percent > 95 THEN '内存使用率过高' ELSE '' END AS errors FROM rep""",
)
def _health(spark, sf_dir):
    rows = accesslog.health_status(_hourly_stats(spark, sf_dir))
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "status",
        F.array_join("warnings", "; ").alias("warnings"), F.array_join("errors", "; ").alias("errors"),
    )


@query(
    "threshold_alerts",
    b.views("access_log", more=_WITH_MEMORY)
    + """SELECT strftime(w, '%Y-%m-%d %H') AS hour, unnest(list_filter([CASE WHEN hit_rate < 20 THEN printf('warning:缓存命中率过低: %.2f%%', hit_rate) END,
           CASE WHEN memory_percent > 90 THEN (CASE WHEN memory_percent > 95 THEN 'critical' ELSE 'warning' END) || printf(':内存使用率过高: %.2f%%', memory_percent) END,
           CASE WHEN error_count > 4 THEN 'error:错误数量过多: ' || error_count END,
           CASE WHEN slow_operations > 8 THEN 'warning:慢操作数量过多: ' || slow_operations END], lambda x: x IS NOT NULL)) AS alert FROM rep""",
)
def _alerts(spark, sf_dir):
    limits = accesslog.Thresholds(errors=4, slow=8)
    rows = accesslog.threshold_alerts(_hourly_stats(spark, sf_dir), limits)
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), F.concat_ws(":", "level", "message").alias("alert")
    )


def error_alerts(spark, sf_dir):
    """An alert per failed operation, keyed by level and data type."""
    log = b.access_log(spark, sf_dir).where(F.col("op") == "error")
    return log.select("seq", "ts", F.concat(F.lit("error:"), "data_type").alias("alert_key"))


def chain_sql(rows: str, gap: str) -> str:
    """CTEs over ``rows`` (k, us, seq, gap columns): ``chain`` has the rows let through one after the other."""
    return f"""rows AS ({rows}),
firsts AS (SELECT k, us, min(seq) AS seq FROM rows GROUP BY ALL),
pointers AS MATERIALIZED (
  SELECT a.k, a.us, a.seq, b.seq AS nxt FROM (SELECT *, us + {gap} AS t FROM rows) a ASOF JOIN firsts b ON a.k = b.k AND a.t <= b.us),
chain(k, seq) AS (
  SELECT k, arg_min(seq, (us, seq)) FROM rows GROUP BY k
  UNION
  SELECT p.k, p.nxt FROM chain c JOIN pointers p USING (k, seq) WHERE p.nxt IS NOT NULL)"""


_ERRORS = "SELECT 'error:' || data_type AS k, epoch_us(ts) AS us, seq FROM access_log WHERE op = 'error'"


@query(
    "suppress_repeats",
    b.views("access_log", more=chain_sql(_ERRORS, "7200000000"), recursive=True) + "SELECT seq, k AS alert_key FROM chain",
)
def _suppress(spark, sf_dir):
    sent = greedy.suppress_repeats(error_alerts(spark, sf_dir), quiet=timedelta(hours=2))
    return sent.select("seq", "alert_key")


@query(
    "suppress_repeats_chained",
    b.views("access_log", more=chain_sql(_ERRORS.replace("'error:' || data_type", "'all'"), "600000000"), recursive=True)
    + "SELECT seq, k AS alert_key FROM chain",
)
def _suppress_chained(spark, sf_dir):
    """One key for all alerts, whose pieces are decided by pointer doubling."""
    alerts = error_alerts(spark, sf_dir).withColumn("alert_key", F.lit("all"))
    return greedy.suppress_repeats(alerts, quiet=timedelta(minutes=10), scan_rows=0).select("seq", "alert_key")


# milliseconds read as seconds, so that requests overlap
_GETS = """SELECT key AS k, epoch_us(ts) AS us, seq, greatest(0, least(round(duration_ms * 1000 * 1000)::BIGINT, 1800000001)) AS gap
  FROM access_log WHERE op = 'get'"""


@query(
    "coalescing_savings",
    b.views("access_log", more=chain_sql(_GETS, "gap"), recursive=True)
    + """SELECT total_requests, merged_requests, merged_requests AS saved_queries, round(merged_requests / total_requests * 100, 6) AS savings_rate
         FROM (SELECT (SELECT count(*) FROM rows) AS total_requests, (SELECT count(*) FROM rows) - (SELECT count(*) FROM chain) AS merged_requests)""",
)
def _coalescing(spark, sf_dir):
    log = b.access_log(spark, sf_dir).where(F.col("op") == "get")
    slow = log.withColumn("duration_ms", F.col("duration_ms") * 1000)
    merged = greedy.merge_requests(slow, limit=timedelta(minutes=30))
    return _rounded(greedy.merge_savings(merged), "savings_rate")


# --- retention --------------------------------------------------------------------------

_TTL = """
ttl AS (
  SELECT *, CASE WHEN ttl_ms <= 0 THEN 900000 ELSE least(86400000, greatest(60000, ttl_ms)) END AS ttl2,
    created_at + to_milliseconds(CASE WHEN ttl_ms <= 0 THEN 900000 ELSE least(86400000, greatest(60000, ttl_ms)) END * 480) AS expiry
  FROM inventory
)"""
INV = b.views("inventory", more=_TTL)
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _entries(spark, sf_dir):
    """Inventory with the clamped TTL; 480 times as long, so that some entries are alive."""
    ttl = retention.clamp_ttl(F.col("ttl_ms"))
    rows = b.inventory(spark, sf_dir).withColumn("ttl_ms", ttl)
    return rows.withColumn("expiry", retention._plus_ms(F.col("created_at"), ttl * 480))


@query(
    "assign_ttl",
    b.views("access_log")
    + """SELECT key, ttl_ms, strftime(t0, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(t0 + to_milliseconds(ttl_ms), '%Y-%m-%d %H:%M:%S.%f') AS expiry FROM (
           SELECT key, max(ts) AS t0, CASE WHEN arg_max(size_bytes, (ts, seq)) <= 0 THEN 900000
              ELSE least(86400000, greatest(60000, arg_max(size_bytes, (ts, seq)) * 60)) END AS ttl_ms FROM access_log WHERE op = 'set' GROUP BY key)""",
)
def _assign(spark, sf_dir):
    writes = b.access_log(spark, sf_dir).where(F.col("op") == "set").withColumn("ttl_ms", F.col("size_bytes") * 60)
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return retention.assign_ttl(writes).select(
        "key", "ttl_ms", F.date_format("created_at", stamp).alias("created_at"), F.date_format("expiry", stamp).alias("expiry")
    )


@query(
    "ttl_status",
    INV
    + f"""SELECT key, greatest(0, (epoch_us(expiry) - epoch_us({_NOW})) // 1000) AS remaining_ms, {_NOW} > expiry AS expired FROM ttl""",
)
def _status(spark, sf_dir):
    return retention.ttl_status(_entries(spark, sf_dir), b.AS_OF).select("key", "remaining_ms", "expired")


@query(
    "ttl_stats",
    INV
    + f"""SELECT count(*) AS total_entries, count(*) FILTER (WHERE {_NOW} > expiry) AS expired_entries,
          count(*) FILTER (WHERE {_NOW} <= expiry) AS active_entries, CAST(floor(sum(ttl2) / count(*)) AS BIGINT) AS avg_ttl_ms FROM ttl""",
)
def _ttl_stats(spark, sf_dir):
    return retention.ttl_stats(_entries(spark, sf_dir), b.AS_OF)


@query(
    "extend_ttl",
    INV
    + f"""SELECT key, CASE WHEN {_NOW} > expiry THEN 'key has expired' ELSE '' END AS error,
            CASE WHEN {_NOW} > expiry THEN -1 ELSE (epoch_us(least(expiry + to_milliseconds(access_count * 3600000), {_NOW} + INTERVAL 1 DAY)) - epoch_us({_NOW})) // 1000 END AS ttl_ms
          FROM ttl WHERE access_count > 0 UNION ALL SELECT 'missing' || access_count, 'key not found', -1 FROM (SELECT DISTINCT access_count FROM ttl)""",
)
def _extend(spark, sf_dir):
    rows = _entries(spark, sf_dir)
    wanted = rows.where(F.col("access_count") > 0).select("key", (F.col("access_count") * 3600000).alias("add_ms"))
    missing = rows.select(F.concat(F.lit("missing"), F.col("access_count").cast("string")).alias("key"), F.lit(1).cast("long").alias("add_ms"))
    done = retention.extend_ttl(rows, wanted.unionByName(missing.distinct()), b.AS_OF)
    return done.select("key", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("ttl_ms", F.lit(-1)).alias("ttl_ms"))


@query(
    "inventory_stats",
    INV
    + f"""SELECT count(*) AS total_items, CAST(sum(size_bytes) AS BIGINT) AS total_size, CAST({MAX} AS BIGINT) AS max_size,
          round(sum(size_bytes) * 100e0 / {MAX}, 6) AS memory_usage, CAST(sum(access_count) AS BIGINT) AS total_accesses,
          count(*) FILTER (WHERE {_NOW} > expiry) AS expired_items FROM ttl""",
)
def _inventory(spark, sf_dir):
    return _rounded(retention.inventory_stats(_entries(spark, sf_dir), MAX, b.AS_OF), "memory_usage")


@query(
    "entry_size",
    b.views("articles") + "SELECT id, 64 + strlen(content) AS text_size, 64 + 100 * len(tags) AS list_size, CAST(1088 AS BIGINT) AS other_size FROM articles",
)
def _entry_size(spark, sf_dir):
    return b.articles(spark, sf_dir).select(
        "id", retention.entry_size(text=F.col("content")).alias("text_size"),
        retention.entry_size(items=F.col("tags")).alias("list_size"), retention.entry_size().alias("other_size"),
    )


@query(
    "resolve_expiry",
    INV
    + f"""SELECT key, CASE WHEN access_count % 2 = 0 THEN strftime(created_at + to_milliseconds(ttl2), '%Y-%m-%d %H:%M:%S') ELSE strftime(expiry, '%Y-%m-%d %H:%M:%S') END AS expiry FROM ttl""",
)
def _resolve(spark, sf_dir):
    rows = _entries(spark, sf_dir)
    ttl = rows.where(F.col("access_count") % 2 == 0).select(
        "key", retention._plus_ms(F.col("created_at"), F.col("ttl_ms")).alias("expiry")
    )
    return retention.resolve_expiry(rows, ttl).select("key", F.date_format("expiry", "yyyy-MM-dd HH:mm:ss").alias("expiry"))


_IDLE = f"(epoch_us({_NOW}) - epoch_us(last_accessed))"
_RULES = {
    "ttl_only": f"{_NOW} > expiry",
    "lru": f"{_IDLE} > 1800000000",
    "size": "size_bytes >= 1024",
    "mixed": f"({_NOW} > expiry OR {_IDLE} > 1800000000 OR size_bytes >= 1024)",
}
for _strategy, _rule in _RULES.items():

    @query(f"cleanup_candidates_{_strategy}", INV + f"SELECT key FROM ttl WHERE {_rule}")
    def _candidates(spark, sf_dir, strategy=_strategy):
        return _entries(spark, sf_dir).where(retention.should_clean(strategy, b.AS_OF)).select("key")


_BASE = f"(CASE WHEN {_NOW} > expiry THEN 1000 ELSE 0 END + CAST(floor({_IDLE} / 86400000000e0 * 10) AS BIGINT))"
_PRIORITY = f"greatest(0, {_BASE} - CASE WHEN access_count > 0 AND {_BASE} > access_count THEN access_count ELSE 0 END + (size_bytes // 1024) // 100)"


@query("cleanup_priority", INV + f"SELECT key, {_PRIORITY} AS priority FROM ttl")
def _priority(spark, sf_dir):
    return _entries(spark, sf_dir).select("key", retention.cleanup_priority(b.AS_OF).alias("priority"))


_CHOSEN = f"""{_TTL},
chosen AS (
  SELECT key, size_bytes, {_PRIORITY} AS priority, row_number() OVER (ORDER BY {_PRIORITY} DESC, key) AS rank FROM ttl WHERE {_RULES["mixed"]}
  QUALIFY rank <= greatest(1, (SELECT CAST(floor(count(*) * 0.25e0) AS BIGINT) FROM ttl))
)"""


@query("select_for_cleanup", b.views("inventory", more=_CHOSEN) + "SELECT key, priority, rank FROM chosen")
def _select(spark, sf_dir):
    return retention.select_for_cleanup(_entries(spark, sf_dir), b.AS_OF).select("key", "priority", "rank")


@query(
    "predict_cleanup",
    b.views("inventory", more=_CHOSEN)
    + """SELECT (SELECT count(*) FROM ttl) AS total_items, count(*) AS items_to_clean, CAST(sum(size_bytes) AS BIGINT) AS space_to_free,
         round(count(*) * 100e0 / (SELECT count(*) FROM ttl), 6) AS cleanup_percentage, '2024-01-31 00:05' AS next_cleanup FROM chosen""",
)
def _predict(spark, sf_dir):
    rows = _rounded(retention.predict_cleanup(_entries(spark, sf_dir), b.AS_OF), "cleanup_percentage")
    return rows.withColumn("next_cleanup", F.date_format("next_cleanup_time", "yyyy-MM-dd HH:mm")).drop("next_cleanup_time")


for _parity in (True, False):

    @query(
        "lru_eviction" + ("_parity" if _parity else "_exact"),
        INV
        + f"""SELECT key FROM (SELECT key, coalesce(sum(size_bytes) OVER (ORDER BY last_accessed, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed,
                sum(size_bytes) OVER () AS total FROM ttl) WHERE total - {2 if _parity else 1} * freed + 1000000 > 4000000""",
    )
    def _evict(spark, sf_dir, parity=_parity):
        return retention.lru_eviction_set(_entries(spark, sf_dir), 1_000_000, 4_000_000, parity).select("key")


@query(
    "cleanup_run_stats",
    LOG
    + """SELECT coalesce(data_type, 'all') AS strategy, count(*) AS runs, CAST(sum(seq % 7) AS BIGINT) AS items, CAST(sum(size_bytes) AS BIGINT) AS bytes
         FROM access_log WHERE op = 'delete' GROUP BY ROLLUP (data_type)""",
)
def _runs(spark, sf_dir):
    runs = b.access_log(spark, sf_dir).where(F.col("op") == "delete")
    return retention.cleanup_run_stats(
        runs.select(F.col("data_type").alias("strategy"), (F.col("seq") % 7).alias("items_cleaned"), F.col("size_bytes").alias("space_freed"))
    )


@query(
    "average_cleanup_time",
    LOG
    + """SELECT round(sum(duration_ms * CASE WHEN n = 1 THEN 1e0 ELSE pow(2e0, greatest(i, 2) - n - 1) END), 6) AS average_ms
         FROM (SELECT duration_ms, row_number() OVER (ORDER BY ts, seq) AS i, count(*) OVER () AS n
               FROM access_log WHERE op = 'delete')""",
)
def _average(spark, sf_dir):
    runs = b.access_log(spark, sf_dir).where(F.col("op") == "delete")
    return _rounded(retention.average_cleanup_ms(runs), "average_ms")


@query(
    "query_fingerprint",
    b.views("requests")
    + """SELECT request_id, md5('weekly|category=' || category || '&format=' || format || '&sort=' || sort_by || '&|' || start_date) AS fingerprint FROM requests""",
)
def _fingerprint(spark, sf_dir):
    params = F.create_map(F.lit("sort"), "sort_by", F.lit("category"), "category", F.lit("format"), "format")
    return b.requests(spark, sf_dir).select(
        "request_id", query_fingerprint(F.lit("weekly"), params, "start_date").alias("fingerprint")
    )


@query(
    "refresh_ttl",
    b.views("access_log")
    + """SELECT key, least(86400000, greatest(60000, max(size_bytes))) AS ttl_ms, '2024-01-31 00:00:00' AS created,
           strftime(TIMESTAMP '2024-01-31 00:00:00' + to_milliseconds(least(86400000, greatest(60000, max(size_bytes)))), '%Y-%m-%d %H:%M:%S') AS expiry
         FROM access_log GROUP BY key""",
)
def _refreshed(spark, sf_dir):
    asked = b.access_log(spark, sf_dir).groupBy("key").agg(F.max("size_bytes").alias("ttl_ms"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return retention.refresh_ttl(asked, b.AS_OF).select("key", "ttl_ms", stamp("created_at").alias("created"), stamp("expiry").alias("expiry"))
