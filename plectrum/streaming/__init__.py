"""Stateful behaviour over unbounded logs: rate limits, pacing, work done once, positions and epochs.

Each function takes a streaming DataFrame and returns one.  State is kept by key and bounded: by a
watermark or a timeout where the reference lets entries expire, by one small record a key elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Keys without a request for so long are forgotten.
SWEEP_MS = 120_000


def _in_order(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of one batch, in order."""
    return pd.concat(list(frames)).sort_values(list(by), kind="stable")


def rate_limit(requests: DataFrame, key: str, ts: str, order: str, limit: int, window_s: int = 60, sweep_ms: int | None = SWEEP_MS) -> DataFrame:
    """requests plus window_start, place, allowed and retry_after_s, as operators.serving.rate_limit does for a table.

    ts is epoch seconds.  A key's state is its window and count; rows of an earlier window than the state's are
    counted as a window of their own, as the fixed-window limiter does.  A key silent for sweep_ms is forgotten; such
    timeouts keep a query alive, so one that shall end with its input (availableNow) takes None.
    """
    schema = StructType([*requests.schema.fields]).add("window_start", "long").add("place", "long").add("allowed", "boolean").add("retry_after_s", "long")
    names = schema.fieldNames()
    timeout = GroupStateTimeout.NoTimeout if sweep_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def check(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows, out = _in_order(frames, ts, order), []
        for t in rows[ts]:
            now = math.floor(t / window_s) * window_s
            start, count = (now, 1) if now != start else (start, count + 1)
            fine = count <= limit
            out.append((now, count, fine, 0 if fine else math.ceil(now + window_s - t)))
        state.update((start, count))
        if sweep_ms is not None:
            state.setTimeoutDuration(sweep_ms)
        told = pd.DataFrame(out, columns=names[-4:], index=rows.index)
        yield pd.concat([rows, told], axis=1)[names]

    return requests.groupBy(key).applyInPandasWithState(check, schema, "window_start long, count long", "append", timeout)


def pacing(requests: DataFrame, key: str, arrival_ms: str, order: str, per_minute: int) -> DataFrame:
    """requests plus start_ms and wait_ms: starts of a key at least ceil(60000 / per_minute) ms apart."""
    gap = -(-60_000 // per_minute)
    schema = StructType([*requests.schema.fields]).add("start_ms", "long").add("wait_ms", "long")
    names = schema.fieldNames()

    def pace(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows, starts = _in_order(frames, arrival_ms, order), []
        for at in rows[arrival_ms]:
            last = int(at) if last is None else max(int(at), last + gap)
            starts.append(last)
        state.update((last,))
        told = rows.assign(start_ms=starts)
        yield told.assign(wait_ms=told["start_ms"] - told[arrival_ms])[names]

    return requests.groupBy(key).applyInPandasWithState(pace, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def work_once(requests: DataFrame, content_key: str, ts: str, within: str = "10 minutes") -> DataFrame:
    """The first request of each content key; repeats within the time join it and drop out."""
    return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark([content_key])


def latest(rows: DataFrame, key: str, ts: str, *values: str) -> DataFrame:
    """The last saved values of each key, as a native aggregation (update or complete mode)."""
    last = F.max_by(F.struct(*[F.col(v) for v in values]), F.col(ts))
    return rows.groupBy(key).agg(F.max(ts).alias("at"), last.alias("_last")).select(key, "at", "_last.*")


def current_results(results: DataFrame, key: str, epoch: str, order: str) -> DataFrame:
    """Results that no earlier one of their key has overtaken with a later epoch; stale ones are dropped, never merged."""

    def keep(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        rows, kept = _in_order(frames, order), []
        for e in rows[epoch]:
            kept.append(top is None or e >= top)
            top = int(e) if top is None else max(top, int(e))
        state.update((top,))
        yield rows[kept]

    return results.groupBy(key).applyInPandasWithState(keep, results.schema, "top long", "append", GroupStateTimeout.NoTimeout)


def outcome_counts(log: DataFrame, ts: str, outcome: str, window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """start, outcome, n: requests by outcome in windows that close when the watermark has passed them."""
    counted = log.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "outcome", "n")
