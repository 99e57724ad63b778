"""The given tables as streams, with the results their batch forms have."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from feedlens.functions.identity import article_hash
from feedlens.operators import accesslog, retention
from feedlens.session import ensure_checkpoint_dir
from feedlens.sources import pages as web
from feedlens.streaming import ingest, ledger, monitor
from feedlens.streaming.run import drain
from feedlens.workload import bindings as b
from feedlens.workload.operations import chain_sql
from feedlens.workload.registry import query
from feedlens.workload.web import _SINGLE, LANDED_SQL, landed_articles


@query(
    "stream_single_articles",
    f"""WITH {_SINGLE.strip()} SELECT left(sha256(url), 16) AS id, title, md5(content) AS digest, author FROM one""",
)
def _pages(spark, sf_dir):
    landed = b.pages_of(b.read_stream(spark, sf_dir, "pages"))
    rows = drain(ingest.parse_stream(landed, web.extract_single_article))
    return rows.select("id", "title", F.md5("content").alias("digest"), "author")


@query("stream_landed_articles", LANDED_SQL)
def _landed(spark, sf_dir):
    return drain(landed_articles(spark, sf_dir, stream=True))


@query(
    "stream_dedup_articles",
    """SELECT DISTINCT md5(lower(left(split_part(text, chr(10), 1), 120)) || '|' || source) AS key FROM documents""",
)
def _dedup(spark, sf_dir):
    docs = b.read_stream(spark, sf_dir, "documents").select(
        F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"),
        F.col("source").alias("url"),
        F.timestamp_seconds(F.col("doc_id") % 960 * 3600 + 1700000000).alias("published_at"),
    )
    kept = drain(ingest.dedup_stream(docs, delay="60 days"))
    return kept.select(article_hash().alias("key"))


@query(
    "stream_periodic_report",
    b.views("access_log")
    + """SELECT strftime(w, '%Y-%m-%d %H:%M') AS minute, hits, sets, slow_operations FROM (
           SELECT date_trunc('minute', ts) AS w, count(*) FILTER (WHERE op = 'get' AND hit) AS hits, count(*) FILTER (WHERE op = 'set') AS sets,
             count(*) FILTER (WHERE op <> 'error' AND duration_ms > 100) AS slow_operations FROM access_log GROUP BY 1)
         WHERE w + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM access_log)""",
)
def _report(spark, sf_dir):
    log = b.access_log_of(b.read_stream(spark, sf_dir, "events"))
    rows = drain(monitor.report_stream(log))
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "hits", "sets", "slow_operations"
    )


@query(
    "stream_suppress_repeats",
    b.views(
        "access_log",
        more=chain_sql(
            "SELECT 'error:' || data_type AS k, epoch_us(ts) AS us, seq FROM access_log WHERE op = 'error' AND epoch_ms(ts) < "
            "(SELECT epoch_ms(max(ts)) - 600000 FROM access_log WHERE op = 'error')",
            "7200000000",
        ),
        recursive=True,
    )
    + "SELECT seq, k AS alert_key FROM chain",
)
def _suppress(spark, sf_dir):
    log = b.access_log_of(b.read_stream(spark, sf_dir, "events")).where(F.col("op") == "error")
    alerts = log.select("seq", "ts", F.concat(F.lit("error:"), "data_type").alias("alert_key"))
    return drain(monitor.suppress_stream(alerts, timedelta(hours=2))).select("seq", "alert_key")


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"


@query(
    "alerts_sent",
    b.views("access_log")
    + """SELECT strftime(w, '%Y-%m-%d %H:%M') AS minute, 'warning' AS level, count(*) AS slow_operations FROM (
           SELECT date_trunc('minute', ts) AS w FROM access_log WHERE op <> 'error' AND duration_ms > 100)
         WHERE w + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM access_log) GROUP BY 1""",
)
def _sent(spark, sf_dir):
    """Slow operations of each minute as alerts, each sent once by way of the ledger."""
    log = b.access_log_of(b.read_stream(spark, sf_dir, "events"))
    reports = monitor.report_stream(log).select("window_start", "slow_operations", F.lit(0.0).alias("memory_percent"), F.lit(100.0).alias("hit_rate"), F.lit(0).alias("error_count"))
    sent = ledger.drained(accesslog.threshold_alerts(reports, accesslog.Thresholds(slow=0)), _folder(spark))
    return sent.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "level", "slow_operations")


@query(
    "entries_removed",
    b.views("access_log")
    + """, w AS (SELECT key, epoch_us(max(ts)) + least(86400000, greatest(60000, arg_max(size_bytes, ts) * 60)) * 1000 AS expired_at_us,
             count(*) AS writes FROM access_log WHERE op = 'set' GROUP BY key)
         SELECT key, writes, expired_at_us // 1000 + 1 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM access_log WHERE op = 'set') AS removed FROM w""",
)
def _removed(spark, sf_dir):
    """The entries of an inventory and whether the clean-up of the expiry stream took them."""
    log = b.access_log_of(b.read_stream(spark, sf_dir, "events")).where(F.col("op") == "set")
    writes = log.select("key", "ts", retention.clamp_ttl(F.col("size_bytes") * 60).alias("ttl_ms"))
    removed = ledger.drained(monitor.expiry_stream(writes), _folder(spark)).select("key", F.lit(True).alias("_gone")).distinct()
    inventory = b.access_log(spark, sf_dir).where(F.col("op") == "set").groupBy("key").agg(F.count(F.lit(1)).alias("writes"))
    return inventory.join(removed, "key", "left").select("key", "writes", F.coalesce("_gone", F.lit(False)).alias("removed"))


@query(
    "stream_dedup_repositories",
    """SELECT lower(p_brand || '/' || p_name) AS full_name, count(*) AS kept FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY 1""",
)
def _dedup_repos(spark, sf_dir):
    parts = b.read_stream(spark, sf_dir, "part")
    repos = parts.select(F.concat("p_brand", F.lit("/"), "p_name").alias("full_name"), F.timestamp_seconds(F.col("p_partkey") + 1_700_000_000).alias("updated_at"))
    kept = drain(ingest.dedup_repo_stream(repos, delay="60 days"))
    return kept.groupBy(F.lower("full_name").alias("full_name")).agg(F.count(F.lit(1)).alias("kept"))


@query(
    "stream_expiry",
    b.views("access_log")
    + """SELECT key, expired_at_us FROM (
           SELECT key, epoch_us(max(ts)) + least(86400000, greatest(60000, arg_max(size_bytes, ts) * 60)) * 1000 AS expired_at_us
           FROM access_log WHERE op = 'set' GROUP BY key)
         WHERE expired_at_us // 1000 + 1 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM access_log WHERE op = 'set')""",
)
def _expiry(spark, sf_dir):
    log = b.access_log_of(b.read_stream(spark, sf_dir, "events")).where(F.col("op") == "set")
    writes = log.select("key", "ts", retention.clamp_ttl(F.col("size_bytes") * 60).alias("ttl_ms"))
    return drain(monitor.expiry_stream(writes))
