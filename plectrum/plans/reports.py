"""Queries on evaluation, review, experiments and latency, each with its DuckDB twin beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectrum.operators import evaluation, experiment, plan
from plectrum.plans.shared import CAPITALS_SQL, Registered, capitals, events, table
from plectrum.sources import text

REGISTERED = Registered()
query = REGISTERED.query


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "role", F.coalesce("text", F.lit("")).alias("text"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.listen_plan(text.text_blocks(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(None)
def fidelity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The independent check of every document's listen plan."""
    return evaluation.fidelity_report(_segments(spark, sf_dir)).withColumn("preserved", F.to_json("preserved"))


@query(None)
def review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.review_packet(_segments(spark, sf_dir))


@query(None)
def construction_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_histogram(evaluation.review_packet(_segments(spark, sf_dir)))


@query(
    """
with t as (select conv_id as doc_id, turn, 'Plazo ' || turn || case when turn % 2 = 0 then ', salvo que no deberá' else '' end || case when turn % 3 = 0 then ' ES1234567890' else '' end as text,
  case when turn % 2 = 1 then 'layout-classification' else 'repeat-detector' end as muted_by from conversations)
select doc_id, 's' || turn as segment_id, case when turn % 2 = 0 then 'salvo que' when turn % 3 = 0 then 'ES1234567890' end as token from t where turn % 2 = 0 or turn % 3 = 0"""
)
def muted_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up furniture: which of it silences a legal term or an identifier, though numbers alone may go where the layout says so."""
    o = F.col("ord")
    said = F.concat(F.lit("Plazo "), o.cast("string"), F.when(o % 2 == 0, ", salvo que no deberá").otherwise(""), F.when(o % 3 == 0, " ES1234567890").otherwise(""))
    by = F.when(o % 2 == 1, "layout-classification").otherwise("repeat-detector")
    rows = _turns(spark, sf_dir).select("doc_id", F.concat(F.lit("s"), o.cast("string")).alias("segment_id"), evaluation.muted_meaning(said, by).alias("token"))
    return rows.where("token IS NOT NULL")


@query("select conv_id as doc_id, turn as ord, role from conversations where role in ('user', 'system')")
def blocks_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.of_types(_turns(spark, sf_dir).withColumnRenamed("role", "type"), "user", "system").select("doc_id", "ord", F.col("type").alias("role"))


@query("select page_id, n from (select page_id, (['page-header', 'paragraph', 'page-footer', 'heading', 'page-number'])[page_id % 5 + 1] as type, length(html) as n from pages) where type in ('paragraph', 'heading')")
def content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under five block types in turn, without the furniture."""
    kind = F.element_at(F.array(*map(F.lit, ("page-header", "paragraph", "page-footer", "heading", "page-number"))), (F.col("page_id") % 5 + 1).cast("int"))
    return evaluation.content(table(spark, sf_dir, "pages").select("page_id", kind.alias("type"), F.length("html").cast("long").alias("n"))).select("page_id", "n")


@query(
    f"""
select conv_id as doc_id, row_number() over (partition by conv_id order by turn) - 1 as entry, 'b' || turn as block_id, coalesce(text, '') as literal_text, {CAPITALS_SQL.format("coalesce(text, '')")} as gold_text
from conversations qualify regexp_matches(coalesce(text, ''), '[a-z]')"""
)
def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in capitals as manual texts; those that capitals do not change are no contrast."""
    from pyspark.sql import Window

    turns = _turns(spark, sf_dir).withColumn("block_id", F.concat(F.lit("b"), F.col("ord").cast("string")))
    entry = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    gold = turns.select("doc_id", entry.cast("long").alias("entry"), "block_id", capitals(F.col("text")).alias("gold_text"))
    return evaluation.gold_pairs(gold, turns)


@query(
    """
with s as (select conv_id as doc_id, 'b' || turn // 2 as block_id, arg_min(turn, turn) as turn from conversations group by 1, 2)
select doc_id, block_id, 's' || turn as segment_id from s where block_id in ('b0', 'b1', 'b2')"""
)
def gold_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns share a block: its gold entry goes to the first; entries of missing blocks drop out."""
    turns = _turns(spark, sf_dir)
    segments = turns.select("doc_id", "ord", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("segment_id"), F.concat(F.lit("b"), F.floor(F.col("ord") / 2).cast("string")).alias("block_id"), F.col("text").alias("spoken_text"))
    gold = turns.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, ("b0", "b1", "b2", "b99")))).alias("block_id"), F.lit("x").alias("gold_text"))
    return evaluation.gold_segments(gold, segments).select("doc_id", "block_id", "segment_id")


@query("select distinct event_type, user_id % 10 as bucket from events where user_id % 10 in (select n_nationkey % 7 from nation)")
def questions_for_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on ten blocks, of which the pairs have seven."""
    asked = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("block_id")).distinct()
    pairs = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 7).cast("long").alias("block_id"))
    return experiment.questions_for(asked, pairs).select("event_type", F.col("block_id").alias("bucket"))


@query("select event_id, case when value <> 1 then floor((value / 2 - 1) / (value - 1) * 10000 + 0.5) / 10000 end as ratio from events")
def capture_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    ratio = evaluation.capture_ratio(v / 2, F.lit(1.0), v)
    return table(spark, sf_dir, "events").select("event_id", (F.floor(ratio * 10_000 + F.lit(0.5)) / 10_000).alias("ratio"))


@query(
    """
with s as (select event_id, ((user_id + (event_id % 50 + 1) * 1831565813) % 4294967296)::ubigint as a from events),
m as (select event_id, a, xor(a, a >> 15) as x, a | 1 as y from s),
t as (select event_id, (((x * (y // 65536)) % 65536 * 65536 + x * (y % 65536)) % 4294967296)::ubigint as t from m),
n as (select event_id, t, xor(t, t >> 7) as x, t | 61 as y from t),
u as (select event_id, xor(t, (t + ((x * (y // 65536)) % 65536 * 65536 + x * (y % 65536)) % 4294967296) % 4294967296) as t from n)
select event_id, xor(t, t >> 14) / 4294967296.0::double as drawn from u"""
)
def seeded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the first fifty numbers of the seed that an event's user is."""
    return table(spark, sf_dir, "events").select("event_id", experiment.random_at(F.col("user_id"), F.col("event_id") % 50).alias("drawn"))


def _experiment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = _turns(spark, sf_dir).select(F.col("doc_id").alias("experiment"), F.col("ord").alias("pair"), F.col("text").alias("literal_text"), capitals(F.col("text")).alias("gold_text"))
    return experiment.assign_sides(pairs, F.col("experiment")), pairs


#: All numbers that an experiment draws from its two seeds; a shuffle as one swap a step; names letter by letter.
_SIDES = """
with recursive g as (select conv_id as e, count(*) as n, list(turn order by turn) as a from conversations group by 1),
d0 as (select e, kind, unnest(range(0, n * 17 + 1)) as i, case kind when 0 then e::ubigint else xor(2654435769::ubigint, e::ubigint) end as seed from g, (select unnest([0, 1]) as kind)),
d1 as (select e, kind, i, ((seed + (i + 1) * 1831565813) % 4294967296)::ubigint as a from d0),
d2 as (select e, kind, i, xor(a, a >> 15) as x, a | 1 as y from d1),
d3 as (select e, kind, i, (((x * (y // 65536)) % 65536 * 65536 + x * (y % 65536)) % 4294967296)::ubigint as t from d2),
d4 as (select e, kind, i, t, xor(t, t >> 7) as x, t | 61 as y from d3),
d5 as (select e, kind, i, xor(t, (t + ((x * (y // 65536)) % 65536 * 65536 + x * (y % 65536)) % 4294967296) % 4294967296) as t from d4),
draws as (select e, kind, i, xor(t, t >> 14) / 4294967296.0::double as x from d5),
s as (
  select e, n, a, n - 1 as i, 0::bigint as d from g union all
  select s.e, s.n, list_transform(range(1, s.n + 1), lambda k: case when k = s.i + 1 then s.a[floor(r.x * (s.i + 1))::bigint + 1] when k = floor(r.x * (s.i + 1))::bigint + 1 then s.a[s.i + 1] else s.a[k] end), s.i - 1, s.d + 1
  from s join draws r on r.e = s.e and r.kind = 0 and r.i = s.d where s.i > 0),
o as (select e, unnest(a) as pair, generate_subscripts(a, 1) - 1 as p from s where i <= 0),
names as (
  select o.e, o.p, r.i - o.p * 17 >= 9 as on_right, 'g3a-' || string_agg(substr('abcdefghjkmnpqrstuvwxyz23456789', floor(r.x * 31)::int + 1, 1), '' order by r.i) as clip
  from o join draws r on r.e = o.e and r.kind = 1 and r.i between o.p * 17 + 1 and o.p * 17 + 16 group by 1, 2, 3)
select o.e as experiment, o.p::int as presentation_order, o.pair, l.clip as left_clip, r.clip as right_clip, case when x.x < 0.5 then 'gold' else 'literal' end as left_condition
from o join names l on l.e = o.e and l.p = o.p and not l.on_right join names r on r.e = o.e and r.p = o.p and r.on_right join draws x on x.e = o.e and x.kind = 1 and x.i = o.p * 17
"""


@query(_SIDES)
def side_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as experiments, seeded with their number."""
    return _experiment(spark, sf_dir)[0]


@query("select conv_id as experiment, turn as pair, 1.0::double as char_ratio, true as matched from conversations where coalesce(text, '') <> ''")
def clip_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both clips of a pair are equally long where capitals have as many letters."""
    assigned, pairs = _experiment(spark, sf_dir)
    same = pairs.where((F.col("literal_text") != "") & (F.length("gold_text") == F.length("literal_text")))
    return experiment.clip_balance(experiment.clips(assigned, same)).select("experiment", "pair", "char_ratio", "matched")


# --- latency ----------------------------------------------------------------------------------------

#: A request a user and thousand events, an attempt an event; times in milliseconds.
_ATTEMPTS = """
a as (select user_id, event_id // 1000 as run, epoch_us(ts) // 1000 as start_ms, epoch_us(ts) // 1000 + floor(value * 10)::bigint + 1 as end_ms, event_type not in ('error', 'signup') as ok,
  case event_type when 'error' then 503 when 'signup' then 429 else 200 end as status, row_number() over (partition by user_id, event_id // 1000 order by ts, event_id) as attempt from events),
g as (select *, start_ms - lag(end_ms) over (partition by user_id, run order by attempt) as gap from a),
q as (select user_id, run, count(*) as attempts, count(*) - 1 as retries, arg_min(start_ms, attempt) as s, max(end_ms) as ended, bool_or(ok) as ok, arg_max(end_ms - start_ms, attempt) filter (where ok) as wire_ms,
  array_to_string(list(gap order by attempt) filter (where gap is not null), ',') as gaps, array_to_string(list(status order by attempt), ',') as codes, count(case when status = 429 then 1 end) as n429 from g group by 1, 2),
r as (select *, ended - s + 50 as total_ms, 50::bigint as queue_wait_ms, case when ok then 2000 end as audio_ms, case when ok and wire_ms > 0 then floor(wire_ms / 2000 * 1000 + 0.5) / 1000 end as rtf from q)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    log = events(spark, sf_dir).withColumn("request_id", F.struct("user_id", F.floor(F.col("event_id") / 1000).alias("run")))
    took = F.floor(F.col("value") * 10).cast("long") + 1
    kind = F.col("event_type")
    attempts = log.select(
        "request_id", F.row_number().over(Window.partitionBy("request_id").orderBy("ms", "event_id")).alias("attempt"), F.col("ms").alias("start_ms"), (F.col("ms") + took).alias("end_ms"),
        (~kind.isin("error", "signup")).alias("ok"), F.when(kind == "error", 503).when(kind == "signup", 429).otherwise(200).alias("status"), F.lit(None).cast("long").alias("first_ms"),
    )
    asked = attempts.groupBy("request_id").agg((F.min_by("start_ms", "attempt") - 50).alias("enqueued_ms"), F.max("end_ms").alias("ended_ms"), F.bool_or("ok").alias("ok")).withColumn("audio_ms", F.lit(2000).cast("long"))
    return evaluation.request_report(asked, attempts)


@query(f"with {_ATTEMPTS} select user_id, run, ok, total_ms, queue_wait_ms, attempts, retries, coalesce(gaps, '') as gaps, codes, wire_ms, rtf from r")
def request_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _requests(spark, sf_dir).select(
        "request_id.user_id", "request_id.run", "ok", "total_ms", "queue_wait_ms", "attempts", "retries", joined("backoff_gaps_ms").alias("gaps"), joined("status_codes").alias("codes"), "wire_ms", "rtf"
    )


def _at(value: str, p: float) -> str:
    return f"(select list_sort(list({value}))[least(count({value}) - 1, floor(count({value}) * {p}))::int + 1] from r where ok and {value} is not null)"


@query(
    f"""with {_ATTEMPTS} select count(*) as requested, count(case when ok then 1 end) as successes, count(case when not ok then 1 end) as failures, sum(retries)::bigint as retries, sum(attempts)::bigint as wire_requests,
  sum(n429)::bigint as count_429, sum(audio_ms) / 1000 as audio_seconds, {_at("wire_ms", 0.5)} as wire_p50, {_at("wire_ms", 0.95)} as wire_p95, {_at("total_ms", 0.5)} as total_p50, {_at("queue_wait_ms", 0.95)} as queue_wait_p95, {_at("rtf", 0.5)} as rtf_p50 from r"""
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_report(_requests(spark, sf_dir)).drop("ttfa_p50", "ttfa_p95")


@query(
    """
with e as (select event_type, epoch_us(ts) // 1000 as s, epoch_us(ts) // 1000 + 5 + event_id % 7 as t, event_id % 3 <> 0 as ok, (([200, 429, 503, 500])[event_id % 4 + 1]) as status from events)
select event_type, count(*) as requests, count(case when ok then 1 end) as successes, count(case when not ok then 1 end) as failures, min(case when ok then t - s end) as latency_min_ms, max(case when ok then t - s end) as latency_max_ms,
  max(t) - min(s) as wall_ms, count(*) as wire_requests, count(case when status = 429 then 1 end) as count_429, count(case when status >= 500 then 1 end) as count_5xx, 0::bigint as retries,
  floor(count(*) / (max(t) - min(s)) * 60000 + 0.5)::bigint as per_minute from e group by 1"""
)
def burn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    log = events(spark, sf_dir)
    asked = log.select("event_type", F.col("ms").alias("start_ms"), (F.col("ms") + 5 + k % 7).alias("end_ms"), (k % 3 != 0).alias("ok"))
    wire = log.select("event_type", F.element_at(F.array(*map(F.lit, (200, 429, 503, 500))), (k % 4 + 1).cast("int")).alias("status"))
    return evaluation.burn_report(asked, wire, "event_type")


# --- extraction -------------------------------------------------------------------------------------


def _extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as references; the extraction has lost every fifth turn and taken every third for a heading."""
    o = F.col("ord")
    kind = F.when(F.col("role") == "system", "page-header").when(o % 4 == 3, "heading").otherwise("paragraph")
    reference = _turns(spark, sf_dir).withColumns({"type": kind, "page": F.floor(o / 2)}).drop("role")
    got = reference.where(o % 5 != 4).withColumns({"type": F.when((F.col("type") != "page-header") & (o % 3 == 2), "heading").otherwise(F.col("type")), "box": F.when(o % 2 == 0, F.array(F.lit(0.0)))})
    return evaluation.extraction_report(reference, got)


@query(None)
def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extraction(spark, sf_dir)


@query(None)
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.extraction_summary(_extraction(spark, sf_dir))


_EXTRACTED = """
b as (select o_custkey as doc_id, o_orderkey as k, o_orderkey % 4 as v, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ord from orders),
m as (select *, v <> 0 and k % 5 <> 4 as hit, k % 5 <> 4 as got, k % 7 <> 0 as same_page, k % 3 = 2 and v > 1 as wrong from b),
r as (
  select doc_id, count(case when v <> 0 then 1 end) as n, count(case when hit then 1 end) as h, count(case when hit and same_page then 1 end) as p, count(case when hit and wrong then 1 end) as misclassified,
    count(case when v = 1 then 1 end) as heading_reference, count(case when v = 1 and hit then 1 end) as heading_recovered, count(case when v = 2 then 1 end) as list_item_reference,
    count(case when v = 2 and hit and not wrong then 1 end) as list_item_recovered, count(case when v = 0 then 1 end) as chrome_reference, count(case when v = 0 and got then 1 end) as chrome_recovered,
    count(case when got and ord % 2 = 0 and ord // 2 + case when same_page then 0 else 1 end >= 1 then 1 end) as placed, count(case when got then 1 end) as g from m group by 1 having n > 0),
f as (
  select doc_id, n as reference_blocks, floor(h / n * 1000 + 0.5) / 1000 as content_recall, case when h > 0 then floor(p / h * 1000 + 0.5) / 1000 end as page_accuracy, n - h as missed, misclassified,
    heading_reference, heading_recovered, list_item_reference, list_item_recovered, chrome_reference, chrome_recovered, true as in_order, floor(6 * h / (3 * n + 3 * h) * 1000 + 0.5) / 1000 as text_fidelity,
    case when g = 0 then 0.0 else floor(placed / g * 1000 + 0.5) / 1000 end as provenance_coverage from r)"""


def _made_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as blocks with words of their own; the extraction loses, moves and mistakes some."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("page-header", "heading", "list-item", "paragraph"))), (k % 4 + 1).cast("int"))
    said = F.concat_ws(" ", *[F.concat(F.lit(x), k.cast("string")) for x in "abc"])
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    reference = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("k"), at.alias("ord"), kind.alias("type"), said.alias("text")).withColumn("page", F.floor(F.col("ord") / 2))
    k = F.col("k")
    got = reference.where(k % 5 != 4).withColumns({
        "type": F.when((k % 3 == 2) & (k % 4 > 1), "heading").otherwise(F.col("type")), "page": F.col("page") + F.when(k % 7 == 0, 1).otherwise(0), "box": F.when(F.col("ord") % 2 == 0, F.array(F.lit(0.0))),
    })
    return evaluation.extraction_report(reference.drop("k"), got.drop("k"))


@query(f"with {_EXTRACTED} select * from f")
def extraction_report_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made_extraction(spark, sf_dir).drop("footnote_reference", "footnote_recovered", "table_cell_reference", "table_cell_recovered")


@query(
    f"""with {_EXTRACTED} select floor(avg(text_fidelity) * 1000 + 0.5) / 1000 as mean_text_fidelity, floor(avg(content_recall) * 1000 + 0.5) / 1000 as mean_content_recall, 0::bigint as order_failures,
  0::bigint as tables_detected, 0::bigint as tables_present from f"""
)
def extraction_summary_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.extraction_summary(_made_extraction(spark, sf_dir))
