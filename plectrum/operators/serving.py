"""Serving behaviour as data: rate limits, pacing, caches, positions and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_limit(requests: DataFrame, key: str, ts: str, order: str, limit: int, window_s: int = 60) -> DataFrame:
    """Adds window_start, place, allowed and retry_after_s: epoch-aligned windows, the first ``limit`` pass.

    ts is in epoch seconds (long or double).
    """
    start = (F.floor(F.col(ts) / window_s) * window_s).cast("long")
    step = requests.withColumn("window_start", start)
    place = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, order))
    wait = F.ceil(F.col("window_start") + window_s - F.col(ts)).cast("long")
    step = step.withColumn("place", place.cast("long")).withColumn("allowed", F.col("place") <= limit)
    return step.withColumn("retry_after_s", F.when(F.col("allowed"), F.lit(0).cast("long")).otherwise(wait))


def pacing_starts(requests: DataFrame, by: str, arrival_ms: str, order: str, per_minute: int) -> DataFrame:
    """Starts at least ceil(60000 / per_minute) ms apart: i * T plus the running maximum of arrival - i * T."""
    gap = -(-60_000 // per_minute)
    w = Window.partitionBy(by).orderBy(arrival_ms, order)
    step = requests.withColumn("_i", (F.row_number().over(w) - 1).cast("long"))
    lead = F.max(F.col(arrival_ms) - F.col("_i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn("start_ms", (F.col("_i") * gap + lead).cast("long")).withColumn("wait_ms", F.col("start_ms") - F.col(arrival_ms)).drop("_i")


def evict(entries: DataFrame, by: str, size: str, mtime: str, key: str, cap: Column | int) -> DataFrame:
    """Entries that a byte-capped cache keeps: the newest while their sum fits, oldest dropped first."""
    newest = Window.partitionBy(by).orderBy(F.desc(mtime), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    return entries.withColumn("kept_bytes", F.sum(size).over(newest)).where(F.col("kept_bytes") <= cap)


def alive(entries: DataFrame, ts: str, now: Column, ttl: int) -> DataFrame:
    """Entries younger than or as old as ttl; those without a time stay."""
    return entries.where(F.col(ts).isNull() | (F.col(ts) >= now - ttl))


def latest(rows: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """The last row of each key, each value the last that is not null."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = rows.select(key, order.alias("at"), *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])
    return step.groupBy(key).agg(F.max("at").alias("at"), *[F.first(v).alias(v) for v in values])


def top_recent(rows: DataFrame, by: str, order: str, key: str, n: int = 5) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(order), F.desc(key))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def request_metrics(attempts: DataFrame) -> DataFrame:
    """request_id, attempt, start_ms, end_ms, status to attempts, retries and backoff gaps a request."""
    w = Window.partitionBy("request_id").orderBy("attempt")
    step = attempts.withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(w))
    return step.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("attempts"), (F.count(F.lit(1)) - 1).alias("retries"), F.sort_array(F.collect_list(F.struct("attempt", "gap"))).alias("gaps"),
        F.count_if(F.col("status") == 429).alias("throttled"), F.count_if(F.col("status") >= 500).alias("failed"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
    )


def gap_after(last_word: Column, is_last: Column) -> Column:
    """Seconds of silence after a chunk by the last mark of its last word; none after the last chunk."""
    by_mark = F.when(last_word.rlike(r"[.!?\n]\z"), 0.4).when(last_word.rlike(r"[,;:]\z"), 0.05).otherwise(0.1)
    return F.when(is_last | last_word.isNull(), F.lit(0.0)).otherwise(by_mark)


def timeline(chunks: DataFrame, by: str, order: str, duration: str, gap: str) -> DataFrame:
    """Each chunk's start: durations and gaps before it; an unknown duration (null) counts nothing but its gap."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("start", F.coalesce(F.sum(F.coalesce(F.col(duration), F.lit(0.0)) + F.col(gap)).over(w), F.lit(0.0)))


def chunk_at(points: DataFrame, chunks: DataFrame, by: str, time: str, start: str, length: Column) -> DataFrame:
    """The chunk whose [start, start + length) holds each time; times past the end have none.

    A chunk of unknown length (null) holds all times from its start on, so none after it is reached.  A backward as-of
    lookup: points and starts are merged in time order and the last start is carried forward, one sort by key instead of
    a range join.
    """
    earlier = Window.partitionBy(by).orderBy(start, "chunk").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(length.isNull()).over(earlier), F.lit(False))
    known = chunks.withColumn("_past", reached).where(~F.col("_past")).drop("_past")
    marks = known.select(by, F.col(start).alias("_t"), F.struct(F.col(start).alias("start"), length.alias("length"), "chunk").alias("_c"), F.lit(None).cast(points.schema.simpleString()).alias("_p"))
    asks = points.select(by, F.col(time).alias("_t"), F.lit(None).cast(marks.schema["_c"].dataType.simpleString()).alias("_c"), F.struct(*points.columns).alias("_p"))
    w = Window.partitionBy(by).orderBy("_t", F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    merged = marks.unionByName(asks).withColumn("_last", F.last("_c", ignorenulls=True).over(w)).where(F.col("_p").isNotNull())
    inside = F.col("_last").isNotNull() & (F.col("_last.length").isNull() | (F.col("_t") < F.col("_last.start") + F.col("_last.length")))
    return merged.select("_p.*", F.when(inside, F.col("_last.chunk")).alias("chunk"))


def chapters(headings: DataFrame) -> DataFrame:
    """doc_id, start, title in order: a chapter that repeats its predecessor's chunk goes."""
    w = Window.partitionBy("doc_id").orderBy("start", "ord")
    return headings.withColumn("_before", F.lag("start").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("start"))).drop("_before")


def cache_misses(wanted: DataFrame, cached: DataFrame, key: str, order: str) -> DataFrame:
    """key, first, requests: one piece of work for each key that the cache lacks."""
    new = wanted.join(cached.select(key).distinct(), key, "left_anti")
    return new.groupBy(key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("requests"))


def engine_for(requests: DataFrame, engines: DataFrame) -> DataFrame:
    """requests (wanted, ...) plus engine: the wanted one if it is there, else the first in place.

    engines: place, engine.  Spark broadcasts them if it measures them small.
    """
    first = engines.agg(F.min_by("engine", "place").alias("_first"))
    there = engines.select(F.col("engine").alias("wanted"), F.col("engine").alias("_there"))
    hit = requests.join(there, "wanted", "left").join(F.broadcast(first))  # one row
    return hit.withColumn("engine", F.coalesce("_there", "_first")).drop("_there", "_first")


def upsert(stored: DataFrame, saved: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key: of the stored and the saved rows the last in order."""
    both = stored.unionByName(saved)
    last = both.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in both.columns]), order).alias("_last"))
    return last.select("_last.*")


def prune(entries: DataFrame, by: str, ts: str, key: str, now: Column, ttl: int, most: int = 200) -> DataFrame:
    """The entries one bounded pass over the oldest removes: expired ones among the first ``most``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(ts, key))
    return entries.withColumn("_place", place).where((F.col("_place") <= most) & (F.col(ts) < now - ttl)).drop("_place")


def current_epoch(results: DataFrame, by: str, epoch: str, order: Column) -> DataFrame:
    """results plus kept: whether no result before it has a later epoch."""
    top = F.max(epoch).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("kept", F.col(epoch) == top)


def rebuffers(audio: DataFrame, by: str, order: Column, at: str, length: str) -> DataFrame:
    """by, rebuffers, frozen_ms: audio that came after the end of the one before it left playing without any."""
    horizon = F.lag(F.col(at) + F.col(length)).over(Window.partitionBy(by).orderBy(order))
    step = audio.withColumn("_gap", F.when(horizon < F.col(at), F.col(at) - horizon))
    return step.groupBy(by).agg(F.count("_gap").alias("rebuffers"), F.coalesce(F.sum("_gap"), F.lit(0)).cast("long").alias("frozen_ms"))
