"""Scans that decide row by row within a key: alert suppression and request merging.

Both let a row through and then absorb later rows of its key for a limited time, so the rows let
through are a chain: each points to the first later row that it does not absorb. A decision never
reaches across a quiet spell of the limit's length, so keys are cut there. Short pieces are spread
over the cluster and read in order with one remembered row. In longer ones, up to a key without any
quiet spell, every row gets its pointer by a range sort, and the chain is found by pointer doubling:
the rows of a piece are never in one task, and the rounds grow with the logarithm of the chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.times import micros
from feedlens.operators.sequence import with_following, with_position
from feedlens.session import ensure_checkpoint_dir

#: Pieces of more rows are not read by one task.
SCAN_ROWS = 200_000


def _in_pieces(df: DataFrame, key: str, time: str, width_us: int) -> tuple[DataFrame, DataFrame]:
    """Adds ``_us``, ``_piece`` and the rows ``_size`` of the piece, and gives the table of pieces.

    Rows of a key share a piece unless a whole cell of ``width_us`` between them is empty. Cells
    per key are bounded by time, not by rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    timed = df.withColumn("_us", micros(time)).withColumn("_cell", F.floor(F.col("_us") / max(1, width_us)))
    ordered = Window.partitionBy(key).orderBy("_cell")
    cells = timed.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    quiet = F.coalesce(F.col("_cell") - F.lag("_cell").over(ordered) > 1, F.lit(True))
    pieces = cells.withColumn("_quiet", quiet.cast("long")).withColumn("_piece", F.sum("_quiet").over(ordered))
    size = F.sum("_rows").over(Window.partitionBy(key, "_piece"))
    pieces = pieces.select(F.col(key).alias("_of"), F.col("_cell").alias("_at"), "_piece", size.alias("_size")).checkpoint()
    placed = timed.join(pieces, timed[key].eqNullSafe(F.col("_of")) & timed["_cell"].eqNullSafe(F.col("_at")))
    return placed.drop("_of", "_at", "_cell"), pieces


def _scanned(placed: DataFrame, key: str, tie: str) -> DataFrame:
    """Adds ``_lead``: the row is let through; reads each piece in order."""
    ordered = placed.repartition(key, "_piece").sortWithinPartitions(key, "_piece", "_us", tie)
    names = placed.columns

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, until = None, 0
        for batch in batches:
            lead = []
            for k, piece, us, gap in zip(batch[key].astype(object).where(batch[key].notna(), None), batch["_piece"], batch["_us"], batch["_gap"]):
                through = (k, piece) != current or us >= until
                if through:
                    current, until = (k, piece), us + gap
                lead.append(through)
            yield batch.assign(_lead=lead)[[*names, "_lead"]]

    return ordered.mapInPandas(scan, placed.withColumn("_lead", F.lit(True)).schema)


def chain_ids(pointers: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of all rows that can be reached from ``roots`` (id) along ``pointers`` (id, to), by doubling.

    After k rounds the first 2^k rows of every chain are known, and a pointer leads 2^k rows on. Rows
    that nothing points to are dropped first. Each round is checkpointed, so a lost executor costs one round.
    """
    aimed = pointers.select(F.col("to").alias("id")).union(roots.select("id")).distinct()
    step = pointers.filter("to IS NOT NULL").join(aimed, "id", "left_semi").checkpoint()
    reached = roots.select("id").checkpoint()
    while True:
        new = reached.join(step, "id").select(F.col("to").alias("id")).checkpoint()
        if not new.limit(1).count():
            return reached
        reached = reached.union(new).checkpoint()
        further = step.select(F.col("id").alias("to"), F.col("to").alias("_on"))
        step = step.join(further, "to").select("id", F.col("_on").alias("to")).checkpoint()


def _chained(placed: DataFrame, key: str, tie: str) -> DataFrame:
    """The same as ``_scanned`` for pieces of any size."""
    piece = F.struct(F.col(key).alias("k"), F.col("_piece").alias("p"))
    numbered = with_position(placed.withColumn("_key", piece), [F.col("_key"), F.col("_us"), F.col(tie)], "_id").checkpoint()
    here, none = F.col("_id"), F.lit(None).cast("long")
    times = numbered.select("_key", F.col("_us").alias("_t"), here.alias("_slot"), F.lit(0).alias("_after"), here.alias("_at"), none.alias("id"))
    # the question stands before all rows of its time; that of a row that absorbs nothing right behind the row
    slot, after = F.when(F.col("_gap") > 0, -1).otherwise(here), F.when(F.col("_gap") > 0, 0).otherwise(1)
    asks = numbered.select("_key", F.col("_us") + F.col("_gap"), slot, after, none, "_id")
    order = [F.col(c) for c in ("_key", "_t", "_slot", "_after")]
    found = with_following(times.union(asks), order, "_key", F.col("_at"), "to").filter("id IS NOT NULL")
    pointers = found.select("id", "to")
    roots = numbered.groupBy("_key").agg(F.min("_id").alias("id")).select("id")
    through = chain_ids(pointers, roots).select(F.col("id").alias("_id"), F.lit(True).alias("_through"))
    out = numbered.join(through, "_id", "left").withColumn("_lead", F.coalesce("_through", F.lit(False)))
    return out.drop("_through", "_id", "_key")


def _leads(df: DataFrame, key: str, time: str, tie: str, width_us: int, gap: Column, scan_rows: int) -> DataFrame:
    placed, pieces = _in_pieces(df, key, time, width_us)
    placed = placed.withColumn("_gap", F.greatest(gap, F.lit(0)))
    short = _scanned(placed.filter(F.col("_size") <= scan_rows), key, tie)
    if pieces.filter(F.col("_size") > scan_rows).limit(1).count():
        short = short.unionByName(_chained(placed.filter(F.col("_size") > scan_rows), key, tie))
    return short


def suppress_repeats(
    alerts: DataFrame,
    key: str = "alert_key",
    time: str = "ts",
    tie: str = "seq",
    quiet: timedelta = timedelta(minutes=5),
    scan_rows: int = SCAN_ROWS,
) -> DataFrame:
    """Alerts that are sent: none of the same key was sent less than ``quiet`` before.

    Alerts of the same time go by ``tie``; a null key is a key. Pieces of more than ``scan_rows`` rows
    are decided by pointer doubling.
    """
    width = int(quiet.total_seconds() * 1_000_000)
    return _leads(alerts, key, time, tie, width, F.lit(width), scan_rows).filter("_lead").select(*alerts.columns)


def merge_requests(
    requests: DataFrame,
    key: str = "key",
    time: str = "ts",
    duration_ms: str = "duration_ms",
    tie: str = "seq",
    limit: timedelta = timedelta(seconds=30),
    scan_rows: int = SCAN_ROWS,
) -> DataFrame:
    """Adds ``merged``: a request of the same key was running, for ``limit`` at most."""
    width = int(limit.total_seconds() * 1_000_000)
    run = F.round(F.col(duration_ms) * 1000).cast("long")
    gap = F.least(F.coalesce(run, F.lit(0)), F.lit(width + 1))  # the limit itself still merges
    led = _leads(requests, key, time, tie, width, gap, scan_rows)
    return led.select(*requests.columns, (~F.col("_lead")).alias("merged"))


def merge_savings(merged: DataFrame) -> DataFrame:
    """Totals of ``merge_requests``: every merged request saves one query."""
    total, saved = F.count(F.lit(1)), F.count_if("merged")
    return merged.agg(
        total.alias("total_requests"),
        saved.alias("merged_requests"),
        saved.alias("saved_queries"),
        F.when(total == 0, F.lit(0.0)).otherwise(saved / total * 100).alias("savings_rate"),
    )
