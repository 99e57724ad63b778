"""Reports and alerts over a stream of access-log rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from feedlens.operators.accesslog import periodic_report


def report_stream(log: DataFrame, interval: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """``periodic_report`` per closed interval."""
    return periodic_report(log.withWatermark("ts", delay), interval)


def suppress_stream(
    alerts: DataFrame, quiet: timedelta = timedelta(minutes=5), delay: str = "10 minutes"
) -> DataFrame:
    """(alert_key, seq, ts_us) of alerts that are sent, the same ones as in the batch form.

    Input is (alert_key, seq, ts). A key holds its rows back until the watermark has passed their
    time, then decides them in time order, so rows that arrive out of order within ``delay`` are
    judged in event order; later ones are dropped. It holds the rows of ``delay`` and the time of the last
    alert sent, and forgets the key once that is ``quiet`` ago and nothing waits. Rows the
    watermark has not passed when the stream ends stay undecided.
    """
    width = int(quiet.total_seconds() * 1_000_000)

    def step(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sent, times, seqs = state.get if state.exists else (None, [], [])
        waiting = [pd.DataFrame({"ts_us": list(times), "seq": list(seqs)}, dtype="int64")]
        if not state.hasTimedOut:
            waiting += [c[["ts_us", "seq"]] for c in chunks]
        rows = pd.concat(waiting, ignore_index=True).sort_values(["ts_us", "seq"])
        watermark = state.getCurrentWatermarkMs()
        due = rows["ts_us"] // 1000 < watermark
        keep = []
        for us in rows.loc[due, "ts_us"]:
            emit = sent is None or us - sent >= width
            if emit:
                sent = int(us)
            keep.append(emit)
        out, rest = rows[due].loc[np.array(keep, bool)], rows[~due]
        forget = (sent + width) // 1000 if sent is not None else watermark
        if len(rest):
            wake = int(rest["ts_us"].iloc[0]) // 1000
        else:
            wake = forget
        if not len(rest) and forget <= watermark:
            if state.exists:
                state.remove()
        else:
            state.update((sent, rest["ts_us"].tolist(), rest["seq"].tolist()))
            state.setTimeoutTimestamp(max(wake, watermark + 1))
        yield out.assign(alert_key=key[0])[["alert_key", "seq", "ts_us"]]

    timed = alerts.withWatermark("ts", delay).withColumn("ts_us", F.unix_micros("ts"))
    return timed.groupBy("alert_key").applyInPandasWithState(
        step,
        "alert_key string, seq bigint, ts_us bigint",
        "sent bigint, times array<bigint>, seqs array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def expiry_stream(writes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(key, expired_at_us) once event time passes the expiry of a key's latest write.

    Input is (key, ts, ttl_ms) with clamped TTLs. A key keeps its latest write only.
    """

    def step(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            expiry = state.get[1]
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "expired_at_us": [expiry]})
            return
        written, expiry = state.get if state.exists else (-1, -1)
        for chunk in chunks:
            last = chunk.sort_values("ts_us").iloc[-1]
            if last["ts_us"] >= written:
                written, expiry = int(last["ts_us"]), int(last["ts_us"] + last["ttl_ms"] * 1000)
        due = expiry // 1000 + 1
        if due <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame({"key": [key[0]], "expired_at_us": [expiry]})
        else:
            state.update((written, expiry))
            state.setTimeoutTimestamp(due)

    timed = writes.withWatermark("ts", delay).withColumn("ts_us", F.unix_micros("ts"))
    return timed.groupBy("key").applyInPandasWithState(
        step,
        "key string, expired_at_us bigint",
        "written bigint, expiry bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
