"""Retention over an inventory of entries: expiry, clean-up and eviction.

An entry is (key, size_bytes, access_count, last_accessed, created_at, expiry).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.text import byte_len
from feedlens.functions.times import DAY_US, age_us, at
from feedlens.operators.sequence import with_position, with_running_sum

# Default and bounds of a time to live, idle limit, smallest size worth cleaning.
DEFAULT_TTL_MS = 15 * 60 * 1000
MIN_TTL_MS = 60 * 1000
MAX_TTL_MS = 24 * 60 * 60 * 1000
MAX_IDLE_MS = 30 * 60 * 1000
MIN_SIZE = 1024
STRATEGIES = ("ttl_only", "lru", "size", "mixed")
ENTRY_OVERHEAD, LIST_ITEM_BYTES, OTHER_BYTES = 64, 100, 1024


def _plus_ms(moment: Column, ms: Column) -> Column:
    return moment + F.make_dt_interval(secs=(ms / F.lit(1000)).cast("decimal(18,6)"))


def clamp_ttl(ms: Column) -> Column:
    """The default for values up to zero, else within a minute and a day."""
    wanted = F.when(F.coalesce(ms, F.lit(0)) <= 0, F.lit(DEFAULT_TTL_MS)).otherwise(ms)
    return F.least(F.greatest(wanted, F.lit(MIN_TTL_MS)), F.lit(MAX_TTL_MS)).cast("long")


def assign_ttl(writes: DataFrame, time: str = "ts", ttl: str = "ttl_ms", order: str = "seq") -> DataFrame:
    """(key, ttl_ms, created_at, expiry): the latest write of each key wins."""
    latest = writes.groupBy("key").agg(
        F.max_by(F.struct(F.col(time).alias("t"), F.col(ttl).alias("ms")), F.struct(time, order)).alias("w")
    )
    ms = clamp_ttl(F.col("w.ms"))
    return latest.select(
        "key", ms.alias("ttl_ms"), F.col("w.t").alias("created_at"), _plus_ms(F.col("w.t"), ms).alias("expiry")
    )


def is_expired(as_of: datetime | str, expiry: str = "expiry") -> Column:
    return at(as_of) > F.col(expiry)


def extend_ttl(entries: DataFrame, extensions: DataFrame, as_of: datetime | str) -> DataFrame:
    """(key, expiry, ttl_ms, error) for (key, add_ms) requests.

    An unknown or expired key is an error; the new expiry is at most a day from ``as_of``.
    """
    joined = extensions.join(entries.select("key", "expiry"), "key", "left")
    error = F.when(F.col("expiry").isNull(), "key not found").when(is_expired(as_of), "key has expired")
    latest = _plus_ms(at(as_of), F.lit(MAX_TTL_MS))
    moved = F.least(_plus_ms(F.col("expiry"), F.col("add_ms")), latest)
    return joined.select(
        "key",
        F.when(error.isNull(), moved).alias("expiry"),
        F.when(error.isNull(), F.floor(-age_us(moved, as_of) / 1000)).alias("ttl_ms"),
        error.alias("error"),
    )


def refresh_ttl(requests: DataFrame, as_of: datetime | str) -> DataFrame:
    """(key, ttl_ms, created_at, expiry) of keys set anew at ``as_of``."""
    ms = clamp_ttl(F.col("ttl_ms"))
    return requests.select(
        "key", ms.alias("ttl_ms"), at(as_of).alias("created_at"), _plus_ms(at(as_of), ms).alias("expiry")
    )


def ttl_status(entries: DataFrame, as_of: datetime | str) -> DataFrame:
    """Adds the milliseconds left, zero once expired, and the expired flag."""
    left = F.floor(-age_us("expiry", as_of) / 1000)
    return entries.select("*", F.greatest(left, F.lit(0)).alias("remaining_ms"), is_expired(as_of).alias("expired"))


def ttl_stats(entries: DataFrame, as_of: datetime | str) -> DataFrame:
    total, expired = F.count(F.lit(1)), F.count_if(is_expired(as_of))
    return entries.agg(
        total.alias("total_entries"),
        expired.alias("expired_entries"),
        (total - expired).alias("active_entries"),
        F.coalesce(F.floor(F.sum("ttl_ms") / total), F.lit(0)).alias("avg_ttl_ms"),
    )


def entry_size(text: Column | None = None, items: Column | None = None) -> Column:
    """Estimated bytes of an entry that holds text, a list, or something else."""
    if text is not None:
        return byte_len(text) + ENTRY_OVERHEAD
    if items is not None:
        return F.size(items).cast("long") * LIST_ITEM_BYTES + ENTRY_OVERHEAD
    return F.lit(ENTRY_OVERHEAD + OTHER_BYTES).cast("long")


def inventory_stats(entries: DataFrame, max_bytes: int, as_of: datetime | str) -> DataFrame:
    size = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return entries.agg(
        F.count(F.lit(1)).alias("total_items"),
        size.alias("total_size"),
        F.lit(max_bytes).cast("long").alias("max_size"),
        (size / max_bytes * 100).alias("memory_usage"),
        F.coalesce(F.sum("access_count"), F.lit(0)).alias("total_accesses"),
        F.count_if(is_expired(as_of)).alias("expired_items"),
    )


def resolve_expiry(entries: DataFrame, ttl: DataFrame) -> DataFrame:
    """The expiry of the TTL table, else the entry's own."""
    known = ttl.select("key", F.col("expiry").alias("_ttl_expiry"))
    joined = entries.join(known, "key", "left")
    return joined.withColumn("expiry", F.coalesce("_ttl_expiry", "expiry")).drop("_ttl_expiry")


def should_clean(
    strategy: str, as_of: datetime | str, max_idle_ms: int = MAX_IDLE_MS, min_size: int = MIN_SIZE
) -> Column:
    expired = is_expired(as_of)
    idle = age_us("last_accessed", as_of) > max_idle_ms * 1000
    large = F.col("size_bytes") >= min_size
    rules = {"ttl_only": expired, "lru": idle, "size": large, "mixed": expired | idle | large}
    if strategy not in rules:
        raise ValueError(f"unknown strategy {strategy!r}")
    return rules[strategy]


def cleanup_priority(as_of: datetime | str) -> Column:
    """Higher goes first: expired, long idle, large; often used entries go later."""
    days = age_us("last_accessed", as_of) / DAY_US
    base = F.when(is_expired(as_of), F.lit(1000)).otherwise(F.lit(0)) + F.when(
        days > 0, F.floor(days * 10)
    ).otherwise(F.lit(0))
    used = F.col("access_count")
    base = base - F.when((used > 0) & (base > used), used).otherwise(F.lit(0))
    size = F.floor(F.floor(F.col("size_bytes") / 1024) / 100)
    return F.greatest(base + size, F.lit(0)).cast("long")


def select_for_cleanup(
    entries: DataFrame, as_of: datetime | str, strategy: str = "mixed", share: float = 0.25
) -> DataFrame:
    """Candidates by priority, at most ``share`` of all entries and at least one.

    The share may be millions of rows, so they are ranked with ``with_position`` rather than
    by a limit.
    """
    cap = entries.agg(F.greatest(F.floor(F.count(F.lit(1)) * F.lit(share)), F.lit(1))).scalar()
    candidates = entries.where(should_clean(strategy, as_of)).withColumn("priority", cleanup_priority(as_of))
    ranked = with_position(candidates, [F.desc("priority"), F.col("key").asc()], "rank")
    return ranked.where(F.col("rank") <= cap)


def predict_cleanup(
    entries: DataFrame,
    as_of: datetime | str,
    strategy: str = "mixed",
    share: float = 0.25,
    interval_minutes: int = 5,
) -> DataFrame:
    """What the next clean-up would free; the percentage is NULL for an empty inventory."""
    chosen = select_for_cleanup(entries, as_of, strategy, share)
    total = entries.agg(F.count(F.lit(1))).scalar()
    freed = chosen.agg(
        F.count(F.lit(1)).alias("items_to_clean"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("space_to_free")
    )
    return freed.select(
        total.alias("total_items"),
        "items_to_clean",
        "space_to_free",
        (F.col("items_to_clean") / F.nullif(total, F.lit(0)) * 100).alias("cleanup_percentage"),
        _plus_ms(at(as_of), F.lit(interval_minutes * 60000)).alias("next_cleanup_time"),
    )


def lru_eviction_set(entries: DataFrame, needed: int, max_bytes: int, parity: bool = True) -> DataFrame:
    """Entries to evict, least recently used first, until ``needed`` bytes fit.

    ``parity`` counts freed bytes twice, which stops earlier than needed; without it the
    evicted entries make just enough room.
    """
    total = entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).scalar()
    order = [F.col("last_accessed").asc(), F.col("key").asc()]
    summed = with_running_sum(entries, order, F.col("size_bytes"), "_freed").drop("_freed_min")
    before = F.col("_freed") - F.col("size_bytes")
    still_short = total - before * (2 if parity else 1) + needed > max_bytes
    return summed.where(still_short).drop("_freed")


def cleanup_run_stats(runs: DataFrame) -> DataFrame:
    """(strategy, runs, items, bytes) per strategy, with a total under "all"."""
    measures = [
        F.count(F.lit(1)).alias("runs"),
        F.sum("items_cleaned").alias("items"),
        F.sum("space_freed").alias("bytes"),
    ]
    return runs.rollup("strategy").agg(*measures).withColumn("strategy", F.coalesce("strategy", F.lit("all")))


def average_cleanup_ms(runs: DataFrame) -> DataFrame:
    """The running mean (mean + duration) / 2 over all runs in time order, as one row.

    Unrolled, a run weighs half of the run after it and the first as much as the second, so the
    mean is one sum over numbered runs.
    """
    placed = with_position(runs.select("ts", "seq", "duration_ms"), [F.col("ts").asc(), F.col("seq").asc()], "_run")
    count = placed.agg(F.count(F.lit(1))).scalar()
    halvings = count - F.greatest(F.col("_run"), F.lit(2)) + 1
    weight = F.when(count == 1, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -halvings.cast("double")))
    return placed.agg(F.sum(F.col("duration_ms") * weight).alias("average_ms"))
