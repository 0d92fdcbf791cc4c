"""The event log replayed in batches with late rows, each query with its DuckDB twin over the whole log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plectrum.plans.shared import Registered, events
from plectrum.session import fresh_folder
from plectrum.sinks.versions import Versions
from plectrum.streaming import replay, states
from plectrum.streaming.cache import WriteThrough

REGISTERED = Registered()
query = REGISTERED.query

DAY = 86_400_000
#: One event in eleven arrives half a day to three and a half days after its time; a batch takes in what arrives in eight days.
SPAN, LATE, LATE_MS = 8 * DAY, "1 day", DAY


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).withColumn("epoch", F.floor(F.col("event_id") / 100) + F.col("event_id") % 3)
    late = F.when(F.col("event_id") % 11 == 0, (F.col("event_id") % 7 + 1) * (DAY // 2)).otherwise(0)
    return replay.delayed(log, "ms", late, SPAN)


#: Events with their batch (b), the watermark after each (marks), and the events that are not behind the watermark (kept).
LOG_SQL = f"""
with e as (select event_id, user_id, event_type, value, epoch_us(ts) // 1000 as ms, event_id // 100 + event_id % 3 as epoch from events),
b as (select *, (ms + case when event_id % 11 = 0 then (event_id % 7 + 1) * {DAY // 2} else 0 end) // {SPAN} as batch from e),
marks as (select batch, max(max(ms)) over (order by batch) - {LATE_MS} as mark from b group by batch),
before as (select batch, lag(mark) over (order by batch) as mark from marks),
kept as (select b.* from b join before m using (batch) where m.mark is null or ms > m.mark)"""


@query(
    f"""{LOG_SQL},
p as (select *, ms // {DAY} * {DAY} as start, row_number() over (partition by user_id, ms // {DAY} order by batch, ms, event_id) as place from kept)
select event_id, user_id, start // 1000 as window_start, place, place <= 3 as allowed, case when place <= 3 then 0 else (start + {DAY} - ms + 999) // 1000 end as retry_after_s from p"""
)
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events a user and day pass, in the order of arrival; a day's count goes with the watermark."""
    out = replay.replayed(_log(spark, sf_dir), "_batch", lambda s: states.rate_limit(s, "user_id", "ms", "event_id", 3, DAY, LATE), "rate-limit")
    return out.select("event_id", "user_id", "window_start", "place", "allowed", "retry_after_s")


TTL = 6 * DAY


@query(
    f"""{LOG_SQL},
seen as (select distinct user_id, batch from kept),
l as (select s.user_id, s.batch, max(ms) as "at", arg_max(event_id, (ms, event_id)) as event_id from seen s join kept k on k.user_id = s.user_id and k.batch <= s.batch group by 1, 2),
n as (select *, lead(batch) over (partition by user_id order by batch) as next from l),
x as (select n.user_id, n."at", n.event_id, n.next, min(m.batch) as gone from n join marks m on m.batch >= n.batch and m.mark >= n."at" + {TTL} group by 1, 2, 3, 4)
select user_id, "at", event_id, 'saved' as kind from l union all select user_id, "at", event_id, 'expired' from x where next is null or gone < next"""
)
def positions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last event as a saved position that lives for six days."""
    return replay.replayed(_log(spark, sf_dir), "_batch", lambda s: states.latest(s, "user_id", "ms", "event_id", "event_id", ttl_ms=TTL, late=LATE), "positions")


@query(
    f"""{LOG_SQL},
seen as (select distinct user_id, batch from kept),
u as (select s.user_id, s.batch, cast(floor(value) as bigint) % 20 as item, max((ms, event_id)) as last from seen s join kept k on k.user_id = s.user_id and k.batch <= s.batch group by 1, 2, 3),
p as (select *, row_number() over (partition by user_id, batch order by last desc) as place from u)
select user_id, place, item, last[1] as "at" from p where place <= 5"""
)
def recents_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five values, of twenty, that a user saw last, each once."""
    log = _log(spark, sf_dir).withColumn("item", F.floor("value") % 20)
    return replay.replayed(log, "_batch", lambda s: states.recents(s, "user_id", "ms", "event_id", "item", late=LATE), "recents")


@query(
    f"""{LOG_SQL},
seen as (select distinct user_id, batch from kept),
p as (select s.user_id, s.batch, event_id, row_number() over (partition by s.user_id, s.batch order by k.batch desc, ms desc, event_id desc) as place from seen s join kept k on k.user_id = s.user_id and k.batch <= s.batch)
select user_id, count(*) as n, arg_max(event_id, place) as first, arg_min(event_id, place) as last from p where place <= 25 group by user_id, batch"""
)
def diagnostics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last 25 events in the order of arrival."""
    return replay.replayed(_log(spark, sf_dir), "_batch", lambda s: states.ring(s, "user_id", "ms", "event_id", 25, LATE), "diagnostics")


@query(
    f"""{LOG_SQL},
a as (select user_id, batch, max(ms) as last from kept group by 1, 2),
r as (select a.user_id, a.batch, coalesce(m.mark >= max(last) over w + {TTL}, false) as fresh from a join before m using (batch) window w as (partition by user_id order by batch rows between unbounded preceding and 1 preceding)),
s as (select *, sum(fresh::int) over (partition by user_id order by batch) as life from r),
t as (select k.*, max(epoch) over (partition by k.user_id, life order by k.batch, ms, event_id) as top from kept k join s using (user_id, batch))
select event_id, user_id, epoch from t where epoch >= top"""
)
def stale_results_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of an epoch that no earlier arrival of the user has overtaken; a user silent for six days starts anew."""
    out = replay.replayed(_log(spark, sf_dir), "_batch", lambda s: states.current_results(s, "user_id", "ms", "event_id", "epoch", TTL, LATE), "epochs")
    return out.select("event_id", "user_id", "epoch")


@query(
    f"""{LOG_SQL},
k as (select *, event_type || '-' || cast(floor(value) as bigint) as content, first_value(batch) over w as start, row_number() over w as place from b window w as (partition by event_type || '-' || cast(floor(value) as bigint) order by batch, ms, event_id))
select event_id, content, sha256(content) as audio, case when batch > start then 'cache_hit' when place > 1 then 'joined' else 'generated' end as outcome from k"""
)
def write_through_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of event and whole value is content that is made once; every batch is handed over twice, the second time with its answer lost."""
    log = _log(spark, sf_dir).select("event_id", "ms", F.concat_ws("-", "event_type", F.floor("value").cast("string")).alias("content"), "_batch")
    place = fresh_folder(spark, "write-through")
    values = StructType().add("audio", "string")
    cache = WriteThrough(spark, place, log.drop("_batch").schema, "content", "ms", "event_id", lambda keys: keys.withColumn("audio", F.sha2("content", 256)), values)

    def twice(rows: DataFrame, batch_id: int) -> None:
        cache(rows, batch_id)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/answers/batch={batch_id}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        cache(rows, batch_id)

    def start(source: DataFrame, checkpoint: str) -> StreamingQuery:
        return source.writeStream.foreachBatch(twice).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    replay.feed(log, "_batch", start, "write-through-log")
    return cache.answers().select("event_id", "content", "audio", "outcome")


@query(
    """
with e as (select user_id, event_id, epoch_us(ts) // 1000 as ms from events where event_id % 3 = 0 union all select user_id, event_id, epoch_us(ts) // 1000 from events where event_id % 3 = 1 and user_id % 4 = 0),
v as (select 1 as version, * from e where event_id % 3 = 0 union all select unnest([2, 3]), * from e)
select version, user_id, max(ms) as saved_ms, arg_max(event_id, (ms, event_id)) as event_id from v where version < 3 or user_id % 10 <> 9 group by 1, 2"""
)
def position_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved positions in three versions (a third of the events, later events of some users, some users removed), all read at the end."""
    log = events(spark, sf_dir).select("user_id", "event_id", F.col("ms").alias("saved_ms"))
    positions = Versions(spark, fresh_folder(spark, "positions"), log.schema, "user_id", F.struct("saved_ms", "event_id"))
    positions.save(log.where("event_id % 3 = 0"))
    positions.save(log.where("event_id % 3 = 1 AND user_id % 4 = 0"))
    positions.remove(log.where("user_id % 10 = 9"))
    found = [positions.read(v).select(F.lit(v).alias("version"), "user_id", "saved_ms", "event_id") for v in positions.versions()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
