"""Access-log analytics: rates, latencies, memory, health and alerts.

A log row is (seq, ts, op, key, hit, duration_ms, size_bytes, data_type, error) with the
operations get, set, delete, evict and error; (ts, seq) is its order.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.times import age_us
from feedlens.operators.sequence import with_running_sum

SLOW_MS = 100.0
LARGE_BYTES = 1024 * 1024
SAMPLES = 1000


def _op(*names: str) -> Column:
    return F.col("op").isin(*names)


def _hits() -> Column:
    return F.count_if(_op("get") & F.col("hit"))


def _gets() -> Column:
    return F.count_if(_op("get"))


def hit_rate(hits: Column, gets: Column) -> Column:
    return F.when(gets == 0, F.lit(0.0)).otherwise(hits / gets * 100)


def _counters() -> dict[str, Column]:
    return {
        "hits": _hits(),
        "misses": F.count_if(_op("get") & ~F.col("hit")),
        "sets": F.count_if(_op("set")),
        "deletes": F.count_if(_op("delete")),
        "evictions": F.count_if(_op("evict")),
        "hit_rate": hit_rate(_hits(), _gets()),
    }


def _slow_and_large() -> dict[str, Column]:
    return {
        "slow_operations": F.count_if(_op("get", "set", "delete") & (F.col("duration_ms") > SLOW_MS)),
        "large_items": F.count_if(_op("get", "set") & (F.col("size_bytes") > LARGE_BYTES)),
    }


def _errors() -> dict[str, Column]:
    failed = _op("error")
    order = F.when(failed, F.struct("ts", "seq"))
    return {
        "error_count": F.count_if(failed),
        "last_error": F.max_by("error", order),
        "last_error_time": F.max(F.when(failed, F.col("ts"))),
    }


def _agg(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.agg(*[c.alias(name) for name, c in columns.items()])


def operation_counts(log: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Hits, misses, writes and the hit rate; with ``as_of`` also the seconds since the start."""
    columns = _counters()
    if as_of is not None:
        columns["uptime_seconds"] = age_us(F.min("ts"), as_of) / 1_000_000
    return _agg(log, columns)


def latency_stats(log: DataFrame) -> DataFrame:
    """Count, mean, extremes and percentiles per operation.

    Mean and extremes cover all rows; percentiles cover the last 1000 and take the value at
    the 0-based place n*p/100, rounded down. A zero duration counts as "no minimum yet", so the
    minimum is over the rows after the last zero.
    """
    timed = log.where(_op("get", "set", "delete")).select(
        "op", F.struct("ts", "seq").alias("at"), F.round(F.col("duration_ms") * 1_000_000).cast("long").alias("ns")
    )
    zeros = timed.where(F.col("ns") == 0).groupBy("op").agg(F.max("at").alias("_zero"))
    after = F.col("_zero").isNull() | (F.col("at") > F.col("_zero"))
    totals = (
        timed.join(zeros, "op", "left")
        .groupBy("op")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("ns").alias("_sum"),
            F.coalesce(F.min(F.when(after, F.col("ns"))), F.lit(0)).alias("_min"),
            F.max("ns").alias("_max"),
        )
    )
    # a filtered row_number is limited before the shuffle, so 1000 rows per task and operation move
    latest = Window.partitionBy("op").orderBy(F.desc("at"))
    sample = timed.withColumn("_age", F.row_number().over(latest)).where(F.col("_age") <= SAMPLES)
    ranked = sample.withColumn("_place", F.row_number().over(Window.partitionBy("op").orderBy("ns", "_age")) - 1)
    ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("op")))

    def percentile(p: int) -> Column:
        return F.max(F.when(F.col("_place") == F.floor(F.col("_n") * p / 100), F.col("ns"))) / 1_000_000

    percentiles = ranked.groupBy("op").agg(*[percentile(p).alias(f"p{p}_ms") for p in (50, 95, 99)])
    return totals.join(percentiles, "op").select(
        "op",
        "count",
        (F.floor(F.col("_sum") / F.col("count")) / 1_000_000).alias("average_ms"),
        (F.col("_min") / 1_000_000).alias("min_ms"),
        (F.col("_max") / 1_000_000).alias("max_ms"),
        "p50_ms",
        "p95_ms",
        "p99_ms",
    )


def memory_levels(log: DataFrame) -> DataFrame:
    """(seq, ts, op, delta, level): the held bytes after each write, removal or eviction.

    The level never falls below zero: it is the running sum minus its lowest negative value.
    """
    freed = _op("evict") | (_op("delete") & (F.col("size_bytes") > 0))
    moves = log.where(_op("set") | freed).select("seq", "ts", "op", "size_bytes")
    delta = F.when(_op("set"), F.col("size_bytes")).otherwise(-F.col("size_bytes"))
    summed = with_running_sum(
        moves.withColumn("delta", delta), [F.col("ts").asc(), F.col("seq").asc()], F.col("delta"), "_c"
    )
    level = F.col("_c") - F.least(F.lit(0), F.col("_c_min"))
    return summed.select("seq", "ts", "op", "delta", level.alias("level"))


def memory_usage(log: DataFrame, max_bytes: int) -> DataFrame:
    """Current and peak size, shares of ``max_bytes`` and move counts, as one row."""
    return _memory_totals(memory_levels(log), max_bytes)


def _memory_totals(levels: DataFrame, max_bytes: int) -> DataFrame:
    def share(c: str) -> Column:
        return F.col(c) / max_bytes * 100 if max_bytes > 0 else F.lit(0.0)

    sets = _op("set")
    return levels.agg(
        F.coalesce(F.max_by("level", F.struct("ts", "seq")), F.lit(0)).alias("current_size_bytes"),
        F.coalesce(F.max(F.when(sets, F.col("level"))), F.lit(0)).alias("peak_size_bytes"),
        F.count_if(sets).alias("total_allocations"),
        F.count_if(~sets).alias("total_deallocations"),
    ).select(
        "*",
        F.lit(max_bytes).cast("long").alias("max_size_bytes"),
        share("current_size_bytes").alias("usage_percent"),
        share("peak_size_bytes").alias("peak_usage_percent"),
        (F.col("total_allocations") - F.col("total_deallocations")).alias("net_allocations"),
    )


def memory_by_interval(log: DataFrame, max_bytes: int, interval: str = "1 hour") -> DataFrame:
    """(window_start, memory_percent): the level at the end of each interval of the log.

    An interval without moves keeps the level before it, at first none. The window runs over one row
    an interval.
    """
    spans = log.groupBy(F.window("ts", interval).alias("w")).agg(F.count(F.lit(1)).alias("_n"))
    ends = memory_levels(log).groupBy(F.window("ts", interval).alias("w")).agg(F.max_by("level", F.struct("ts", "seq")).alias("_level"))
    order = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    joined = spans.join(ends, "w", "left").select(F.col("w.start").alias("window_start"), "_level")
    level = F.coalesce(F.last("_level", ignorenulls=True).over(order), F.lit(0))
    share = level / max_bytes * 100 if max_bytes > 0 else F.lit(0.0)
    return joined.select("window_start", share.alias("memory_percent"))


def memory_history(log: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` levels, latest first."""
    return memory_levels(log).orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def top_keys(log: DataFrame, n: int = 10) -> DataFrame:
    """The most read keys; a delete starts the count of its key again.

    Reads are counted per key and hour before they meet the deletes; only the hour of a key's last
    delete is read row by row. A busy key moves one row per hour.
    """
    order = F.struct("ts", "seq")
    hour = F.date_trunc("hour", "ts").alias("_hour")
    deletes = log.where(_op("delete")).groupBy("key").agg(F.max(order).alias("_deleted"))
    deletes = deletes.withColumn("_cut", F.date_trunc("hour", "_deleted.ts"))
    gets = log.where(_op("get")).select("key", hour, order.alias("_at"))
    hours = gets.groupBy("key", "_hour").agg(F.count(F.lit(1)).alias("n")).join(deletes, "key", "left")
    after = hours.where(F.col("_cut").isNull() | (F.col("_hour") > F.col("_cut"))).select("key", "n")
    within = gets.join(deletes.withColumnRenamed("_cut", "_hour"), ["key", "_hour"]).where(F.col("_at") > F.col("_deleted"))
    live = after.union(within.select("key", F.lit(1).cast("long")))
    return live.groupBy("key").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "key").limit(n)


def hourly_hits(log: DataFrame) -> DataFrame:
    hits = log.where(_op("get") & F.col("hit"))
    return hits.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("hits"))


def type_distribution(log: DataFrame) -> DataFrame:
    return log.where(_op("set")).groupBy("data_type").agg(F.count(F.lit(1)).alias("sets"))


def size_class(c: str = "size_bytes") -> Column:
    out = F.when(F.lit(False), "")
    for bound, label in vocab.SIZE_CLASSES:
        out = out.when(F.col(c) <= bound, label)
    return out.otherwise(vocab.SIZE_CLASS_OPEN)


def size_distribution(log: DataFrame) -> DataFrame:
    return log.where(_op("get", "set")).groupBy(size_class().alias("size_class")).agg(F.count(F.lit(1)).alias("uses"))


def slow_and_large(log: DataFrame) -> DataFrame:
    return _agg(log, _slow_and_large())


def error_summary(log: DataFrame) -> DataFrame:
    return _agg(log, _errors())


def detailed_stats(log: DataFrame, max_bytes: int) -> DataFrame:
    """One wide row: counters, errors, slow and large operations, memory and latencies."""
    latency = latency_stats(log)
    by_op = latency.agg(F.map_from_entries(F.collect_list(F.struct("op", F.struct(*latency.columns[1:])))))
    counters = _agg(log, {**_counters(), **_slow_and_large(), **_errors()})
    memory = memory_usage(log, max_bytes)
    packed = memory.select(F.struct(*memory.columns))
    return counters.withColumns({"latency": by_op.scalar(), "memory": packed.scalar()})


# --- health and alerts ------------------------------------------------------------------


def health_status(stats: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Status, warnings and errors from rows with hit_rate, memory_percent, error_count and
    slow_operations; other columns are kept."""
    rate, memory = F.col("hit_rate"), F.col("memory_percent")
    warnings = F.array(
        F.when(rate < 50, F.format_string(vocab.HEALTH_LOW_HIT_RATE, rate)),
        F.when(memory > 80, F.format_string(vocab.HEALTH_HIGH_MEMORY, memory)),
        F.when(F.col("error_count") > 0, F.format_string(vocab.HEALTH_ERRORS, F.col("error_count"))),
        F.when(F.col("slow_operations") > 0, F.format_string(vocab.HEALTH_SLOW, F.col("slow_operations"))),
    )
    return stats.select(
        "*",
        F.when(memory > 95, "critical").when(rate < 20, "degraded").otherwise("healthy").alias("status"),
        F.array_compact(warnings).alias("warnings"),
        F.array_compact(F.array(F.when(memory > 95, vocab.HEALTH_MEMORY_ERROR))).alias("errors"),
    )


@dataclass(frozen=True)
class Thresholds:
    hit_rate: float = 20.0
    memory: float = 90.0
    errors: int = 100
    slow: int = 50


def threshold_alerts(stats: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """One row (level, message) per exceeded threshold; the columns of the input are kept."""
    rate, memory = F.col("hit_rate"), F.col("memory_percent")
    errors, slow = F.col("error_count"), F.col("slow_operations")

    def alert(condition: Column, level: Column, message: Column) -> Column:
        return F.when(condition, F.struct(level.alias("level"), message.alias("message")))

    candidates = F.array(
        alert(rate < limits.hit_rate, F.lit("warning"), F.format_string(vocab.ALERT_LOW_HIT_RATE, rate)),
        alert(
            memory > limits.memory,
            F.when(memory > 95, "critical").otherwise("warning"),
            F.format_string(vocab.ALERT_HIGH_MEMORY, memory),
        ),
        alert(errors > limits.errors, F.lit("error"), F.format_string(vocab.ALERT_ERRORS, errors)),
        alert(slow > limits.slow, F.lit("warning"), F.format_string(vocab.ALERT_SLOW, slow)),
    )
    return stats.select("*", F.inline(F.array_compact(candidates)))


def periodic_report(log: DataFrame, interval: str = "1 minute") -> DataFrame:
    """Counters per interval; the same code serves a batch table and a stream."""
    columns = {**_counters(), **_slow_and_large(), "error_count": F.count_if(_op("error"))}
    return (
        log.groupBy(F.window("ts", interval).alias("w"))
        .agg(*[c.alias(name) for name, c in columns.items()])
        .select(F.col("w.start").alias("window_start"), *columns)
    )
