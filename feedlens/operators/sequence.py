"""Positions and running totals over a whole ordered table.

A window without partitions would put the table into one task. Here Spark's own range sort
spreads the rows, each task numbers its part, and a table with one row per part carries the
offsets. The sorted rows are checkpointed first: the range sort draws its bounds from a
sample, so both passes must read the same parts, also after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.session import ensure_checkpoint_dir

_PART, _ROW = "_part", "_row"


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return (
        df.orderBy(*order)
        .withColumns({_PART: F.spark_partition_id(), _ROW: F.monotonically_increasing_id()})
        .checkpoint()
    )


def _before() -> Window:
    """All earlier parts. The window runs over one row per part, at most one per task."""
    return Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the 1-based position in ``order``, which must be total."""
    placed = _placed(df, order)
    starts = (
        placed.groupBy(_PART)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(_ROW).alias("_first"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(_before()), F.lit(0)))
        .drop("_n")
    )
    position = F.col("_start") + F.col(_ROW) - F.col("_first") + 1
    return placed.join(starts, _PART).withColumn(name, position).drop(_PART, _ROW, "_start", "_first")


def with_running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to and including each row, and its running minimum.

    The minimum, ``{name}_min``, is over all prefix sums so far.
    """
    placed = _placed(df.withColumn("_value", value), order)
    within = Window.partitionBy(_PART).orderBy(_ROW)
    local = placed.withColumn("_sum", F.sum("_value").over(within))
    local = local.withColumn("_min", F.min("_sum").over(within))
    parts = (
        local.groupBy(_PART)
        .agg(F.sum("_value").alias("_total"), F.min("_sum").alias("_low"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(_before()), F.lit(0)))
        .withColumn("_past_low", F.min(F.col("_offset") + F.col("_low")).over(_before()))
        .select(_PART, "_offset", "_past_low")
    )
    return (
        local.join(parts, _PART)
        .withColumn(name, F.col("_offset") + F.col("_sum"))
        .withColumn(f"{name}_min", F.least(F.col("_past_low"), F.col("_offset") + F.col("_min")))
        .drop(_PART, _ROW, "_value", "_sum", "_min", "_offset", "_past_low")
    )


def with_following(df: DataFrame, order: list[Column], key: str, value: Column, name: str) -> DataFrame:
    """Adds the ``value`` of the nearest later row of the same ``key`` whose value is not null."""
    placed = _placed(df.withColumn("_value", value), order)
    mark = F.when(F.col("_value").isNotNull(), F.struct(F.col(key).alias("k"), F.col("_value").alias("v")))
    later = Window.partitionBy(_PART).orderBy(F.desc(_ROW)).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_near", F.last(mark, ignorenulls=True).over(later))
    after = Window.orderBy(F.desc(_PART)).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(_PART).agg(F.min_by(mark, F.when(mark.isNotNull(), F.col(_ROW))).alias("_head"))
    parts = parts.withColumn("_next", F.last("_head", ignorenulls=True).over(after)).drop("_head")
    found = F.coalesce("_near", "_next")
    return (
        local.join(parts, _PART)
        .withColumn(name, F.when(found["k"].eqNullSafe(F.col(key)), found["v"]))
        .drop(_PART, _ROW, "_value", "_near", "_next")
    )
