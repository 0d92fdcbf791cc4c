"""Queries on contents, chapters, words, requests and players, each with its DuckDB twin beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plectrum.functions import requests
from plectrum.functions.text import units
from plectrum.operators import navigation, serving
from plectrum.plans import oracle
from plectrum.plans.shared import CAPITALS_SQL, Registered, capitals, events, table

REGISTERED = Registered()
query = REGISTERED.query


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "role", F.coalesce("text", F.lit("")).alias("text"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns two by two as chunks of two segments."""
    return _turns(spark, sf_dir).groupBy("doc_id", F.floor(F.col("ord") / 2).alias("chunk")).agg(
        F.transform(F.sort_array(F.collect_list("ord")), lambda o: F.concat(F.lit("s"), o.cast("string"))).alias("segment_ids")
    )


@query(
    """
with h as (select *, row_number() over (partition by conv_id order by turn) - 1 as pos from conversations where role = 'user')
select conv_id as doc_id, pos, regexp_replace(coalesce(text, ''), '[:.]+$', '') as label, least(turn % 6, 3)::int as depth, turn as block_index from h"""
)
def toc_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as headings of six levels."""
    heads = _turns(spark, sf_dir).withColumns({"type": F.when(F.col("role") == "user", "heading").otherwise("paragraph"), "level": F.col("ord") % 6 + 1})
    return navigation.contents(heads)


@query(
    """
with t as (select conv_id, turn, unnest([turn // 2, (turn + 1) // 2]) as chunk from conversations)
select conv_id as doc_id, 's' || turn as segment_id, min(chunk) as chunk from t group by 1, 2"""
)
def segment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn lies in its own chunk and in the one after half of it; the first counts."""
    both = _turns(spark, sf_dir).select("doc_id", "ord", F.explode(F.array(F.floor(F.col("ord") / 2), F.floor((F.col("ord") + 1) / 2))).alias("chunk"))
    chunks = both.groupBy("doc_id", "chunk").agg(F.collect_set(F.concat(F.lit("s"), F.col("ord").cast("string"))).alias("segment_ids"))
    return navigation.chunk_of_segment(chunks)


@query(
    """
with toc as (select conv_id as doc_id, row_number() over (partition by conv_id order by turn) - 1 as pos, turn from conversations where role = 'user')
select doc_id, pos, turn // 2 as chunk from toc"""
)
def toc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where playing starts for each user turn: entry, block, segment, chunk."""
    turns = _turns(spark, sf_dir)
    toc = navigation.contents(turns.withColumns({"type": F.when(F.col("role") == "user", "heading").otherwise("paragraph"), "level": F.lit(1)}))
    segments = turns.select("doc_id", "ord", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("segment_id"))
    return navigation.chunk_of_entry(toc, turns, segments, _chunks(spark, sf_dir))


@query(
    f"""
with h as (select conv_id as doc_id, turn as ord, trim(regexp_replace({CAPITALS_SQL.format("coalesce(text, '')")}, '[:.]+$', '')) as title, lower(substr(coalesce(text, ''), 1, 60)) as needle from conversations),
c as (select conv_id as doc_id, turn as chunk, lower(coalesce(text, '')) as low from conversations)
select h.doc_id, h.ord, h.title, min(c.chunk) as chunk from h join c on c.doc_id = h.doc_id and contains(c.low, h.needle) where h.title <> '' group by 1, 2, 3"""
)
def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn in capitals as a heading, looked up among the turns themselves."""
    turns = _turns(spark, sf_dir)
    heads = turns.select("doc_id", "ord", capitals(F.col("text")).alias("text"))
    return navigation.heading_chunks(heads, turns.select("doc_id", F.col("ord").alias("chunk"), "text"))


@query(
    """
with l as (select conv_id as doc_id, lower(substr(trim(coalesce(text, '')), 1, 30)) as needle from conversations where role = 'user' and trim(coalesce(text, '')) <> ''),
hit as (select distinct l.doc_id, l.needle, min(b.turn) as turn from l join conversations b on b.conv_id = l.doc_id and contains(lower(coalesce(b.text, '')), l.needle) group by 1, 2)
select conv_id as doc_id, turn as ord, case when (conv_id, turn) in (select doc_id, turn from hit) then 'heading' else 'paragraph' end as type from conversations"""
)
def labelled_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as contents labels: the first turn that has a label's beginning becomes a heading."""
    turns = _turns(spark, sf_dir)
    toc = turns.where("role = 'user'").select("doc_id", F.col("ord").alias("pos"), F.col("text").alias("label"))
    blocks = turns.withColumns({"type": F.lit("paragraph"), "level": F.lit(None).cast("int")})
    return navigation.labelled_headings(toc, blocks).select("doc_id", "ord", "type")


@query(
    """
with s as (select user_id, 'sec ' || event_type as path, min(event_id) as block_index from events where event_type <> 'view' group by 1, 2)
select e.user_id, e.event_id, coalesce(s.block_index, 0) as block_index from events e left join s on s.user_id = e.user_id and s.path = 'sec ' || e.event_type"""
)
def entry_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents links with escapes and fragments to the first block of their section; views have no section."""
    log = table(spark, sf_dir, "events")
    toc = log.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.lit("").alias("label"), F.concat(F.lit("sec%20"), "event_type", F.lit("#p"), F.col("event_id").cast("string")).alias("href"))
    sections = log.where("event_type <> 'view'").select(F.col("user_id").alias("doc_id"), F.concat(F.lit("sec "), "event_type").alias("path"), F.col("event_id").alias("block_index"))
    return navigation.entry_blocks(toc, sections).select(F.col("doc_id").alias("user_id"), F.col("pos").alias("event_id"), "block_index")


@query(
    """
with w as (select conv_id, turn, unnest(string_split(coalesce(text, ''), ' ')) as word, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) as idx from conversations),
d as (select *, 70 * length(word) as dur from w),
o as (select *, coalesce(sum(dur + 40) over (partition by conv_id, turn order by idx rows between unbounded preceding and 1 preceding), 0) as off from d),
p as (select conv_id, turn, unnest([0, 900, 2500, 7000]) as local_ms from conversations)
select p.conv_id, p.turn, p.local_ms, max(case when o.off <= p.local_ms and p.local_ms < o.off + o.dur then o.word end) as active_word,
  count(case when o.off <= p.local_ms then 1 end) as n_started
from p left join o on o.conv_id = p.conv_id and o.turn = p.turn group by 1, 2, 3"""
)
def active_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word that sounds, and how many have started, at four times of each turn."""
    turns = _turns(spark, sf_dir).select(F.struct("doc_id", "ord").alias("by"), F.split("text", " ").alias("w"))
    timed = F.aggregate(
        "w",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<off_ms:int,dur_ms:int,word:string>>").alias("out")),
        lambda s, w: F.struct(
            (s["at"] + 70 * F.length(w) + 40).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("off_ms"), (70 * F.length(w)).alias("dur_ms"), w.alias("word")))).alias("out")
        ),
        lambda s: s["out"],
    )
    words = turns.select("by", timed.alias("words"))
    points = turns.select("by", F.explode(F.array(*map(F.lit, (0, 900, 2500, 7000)))).alias("local_ms"))
    out = navigation.words_at(points, words)
    return out.select(F.col("by.doc_id").alias("conv_id"), F.col("by.ord").alias("turn"), "local_ms", "active_word", F.col("n_started").cast("long").alias("n_started"))


@query(
    """
with p as (select conv_id, turn, turn // 3 as page from conversations)
select conv_id as doc_id, turn as ord, page <> lag(page, 1, 0) over (partition by conv_id order by turn) as shows_page from p"""
)
def page_dividers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.page_dividers(_turns(spark, sf_dir).withColumn("page", F.floor(F.col("ord") / 3))).select("doc_id", "ord", "shows_page")


@query(
    """
select conv_id as doc_id, turn as chunk, array_to_string(list(turn) over (partition by conv_id order by turn rows between current row and 2 following), ',') as wanted
from conversations"""
)
def prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turns(spark, sf_dir).select("doc_id", F.col("ord").alias("chunk"))
    return navigation.prefetch(chunks).withColumn("wanted", F.array_join(F.transform("wanted", lambda x: x.cast("string")), ","))


@query("select event_type, event_id from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events) where r <= 100")
def diagnostics_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred entries of each log, the event's type being the log."""
    return navigation.newest(table(spark, sf_dir, "events"), "event_type", F.struct("ts", "event_id")).select("event_type", "event_id")


@query(
    """
with h as (select conv_id as doc_id, turn as ord, 'T' || turn as title, (turn + 1) // 3 as chunk from conversations where role = 'user'),
k as (select *, lag(chunk) over (partition by doc_id order by ord) as b from h),
own as (select doc_id, ord, title, chunk from k where b is null or b <> chunk),
f as (select doc_id, arg_min(chunk, ord) as first from own group by 1),
d as (select distinct conv_id as doc_id from conversations)
select doc_id, ord, title, chunk as start from own union all
select doc_id, -1, 'talk.' || doc_id, 0 from d left join f using (doc_id) where coalesce(first, 1) > 0"""
)
def chapters_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters at user turns, the conversation's own title first where none starts at the first chunk."""
    turns = _turns(spark, sf_dir)
    placed = turns.where("role = 'user'").select("doc_id", "ord", F.concat(F.lit("T"), F.col("ord").cast("string")).alias("title"), F.floor((F.col("ord") + 1) / 3).alias("chunk"))
    names = turns.select("doc_id").distinct().withColumn("name", F.concat(F.lit("talk."), F.col("doc_id").cast("string"), F.lit(".txt")))
    return navigation.chapters(placed, names)


@query(
    """
select conv_id as doc_id, array_to_string(list('b' || turn order by turn), ',') as block_ids, array_to_string(list(distinct turn // 2 order by turn // 2), ',') as pages,
  min(turn * 0.5)::double as x0, max(turn + 1.5)::double as x1,
  sum(length(coalesce(text, '')) + length(regexp_replace(coalesce(text, ''), '[^\\x{10000}-\\x{10ffff}]', '', 'g')))::bigint as source_end
from conversations group by 1"""
)
def merged_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one segment: its blocks, pages, box and length in UTF-16 units."""
    x = F.col("ord")
    blocks = _turns(spark, sf_dir).withColumns({"page": F.floor(x / 2), "box": F.array(x * 0.5, x * 1.0, x + 1.5, x + 2.0)})
    out = navigation.merged_provenance(blocks, "doc_id")
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return out.select("doc_id", joined("block_ids").alias("block_ids"), joined("pages").alias("pages"), F.get("box", F.lit(0)).alias("x0"), F.get("box", F.lit(2)).alias("x1"), F.col("source_end").cast("long").alias("source_end"))


@query(
    """
select doc_id, length(coalesce(text, '')) + length(regexp_replace(coalesce(text, ''), '[^\\x{10000}-\\x{10ffff}]', '', 'g')) as source_end, 'b' || 0 as block_id
from documents"""
)
def block_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("ord"), F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return navigation.provenance(docs).select("doc_id", F.col("source_end").cast("long").alias("source_end"), F.get("block_ids", F.lit(0)).alias("block_id"))


@query(
    """
with t as (select conv_id, sum(case when role = 'assistant' then length(coalesce(text, '')) * 0.01 end) as known, count(case when role = 'assistant' then 1 end) as n, count(*) as total,
  sum(length(coalesce(text, ''))) as chars from conversations group by 1)
select conv_id, floor((coalesce(known, 0) + greatest(0, total - n) * case when n > 0 then known / n else 0 end) * 1000 + 0.5) / 1000 as seconds,
  floor(n / total * 100 + 0.5)::int as percent, chars::bigint as chars from t"""
)
def estimated_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations are known for assistant turns alone; the others count as the average."""
    known = F.when(F.col("role") == "assistant", F.length("text") * F.lit(0.01))
    sums = _turns(spark, sf_dir).groupBy("doc_id").agg(F.coalesce(F.sum(known), F.lit(0.0)).alias("known"), F.count(known).alias("n"), F.count(F.lit(1)).alias("total"), F.sum(F.length("text")).alias("chars"))
    seconds = navigation.estimated_seconds(F.col("known"), F.col("n"), F.col("total"))
    return sums.select(F.col("doc_id").alias("conv_id"), (F.floor(seconds * 1000 + F.lit(0.5)) / 1000).alias("seconds"), navigation.prepared_share(F.col("n"), F.col("total")).alias("percent"), "chars")


@query("select user_id, max(case when event_type = 'view' then value end) > 0 as resumes from (select user_id, event_type, value from events) group by 1")
def can_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.max(F.when(F.col("event_type") == "view", F.col("value")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(requests.can_resume(at).alias("resumes"))


# --- requests ---------------------------------------------------------------------------------------


@query(
    """
with r as (select doc_id, lang, case doc_id % 3 when 0 then 'auto' when 1 then 'edge' else 'default' end as choice, source = 'src0' as no_edge,
  case doc_id % 4 when 0 then 'ef_dora' when 1 then 'es-ES-ElviraNeural' when 2 then 'en-US-GuyNeural' else 'x' end as voice from documents),
e as (select *, case when choice = 'default' or (choice = 'edge' and not no_edge) then choice when lang = 'es' and not no_edge then 'edge' else 'default' end as engine from r),
l as (select *, case when lang = 'es' and engine = 'edge' then ['es-ES-XimenaNeural', 'es-ES-AlvaroNeural', 'es-ES-ElviraNeural', 'es-MX-JorgeNeural', 'es-AR-EloisaNeural']
  when engine = 'edge' then ['en-US-AriaNeural', 'en-US-GuyNeural', 'en-GB-RyanNeural'] when lang = 'es' then ['ef_dora', 'em_alex', 'em_santa'] else ['af_heart', 'af_bella', 'bf_emma'] end as own from e)
select doc_id, engine, case when list_contains(own, voice) then voice else own[1] end as voice, regexp_full_match(voice, '[a-z]{2}-[A-Z]{2}-[A-Za-z0-9]+Neural') as neural,
  case when engine = 'edge' and not regexp_full_match(voice, '[a-z]{2}-[A-Z]{2}-[A-Za-z0-9]+Neural') then 'fallback' else voice end as sent from l"""
)
def voice_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine and voice of a document by its language, the reader's choice and what is there."""
    k = F.col("doc_id") % 3
    voice = F.element_at(F.array(*map(F.lit, ("ef_dora", "es-ES-ElviraNeural", "en-US-GuyNeural", "x"))), (F.col("doc_id") % 4 + 1).cast("int"))
    available = F.when(F.col("source") == "src0", F.array(F.lit("default"))).otherwise(F.array(F.lit("default"), F.lit("edge")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(k == 0, "auto").when(k == 1, "edge").otherwise("default").alias("choice"), available.alias("available"), voice.alias("wanted"))
    rows = rows.withColumn("engine", requests.resolve_engine(F.col("choice"), F.col("lang"), F.col("available")))
    return rows.select(
        "doc_id", "engine", requests.voice_for(F.col("lang"), F.col("engine"), F.col("wanted")).alias("voice"), requests.is_neural_voice(F.col("wanted")).alias("neural"),
        requests.safe_voice(F.col("engine"), F.col("wanted"), F.lit("fallback")).alias("sent"),
    )


@query(
    """
with r as (select event_id, event_type, value, (event_id * 37) % 12000 as n, value / 50 as speed, event_id % 5 as f, floor(value * 700)::bigint as took from events),
p as (select *, case when n < 1 or n > 10000 or speed < 0.5 or speed > 2 or f = 4 then 'invalid_request' when n > 600 then 'too_large' end as problem,
  case when event_type = 'error' then (case event_id % 3 when 0 then 'provider_timeout' when 1 then 'rate_limited' else 'provider_unavailable' end) end as err from r),
o as (select *, case when problem is not null then 'refused' when event_type = 'signup' then 'queue_rejected' when event_type = 'view' then 'cache_hit' when event_type = 'click' then 'cancelled'
  when err = 'provider_timeout' or took >= 60000 then 'timeout' when err is not null then 'provider_error' else 'generated' end as outcome from p)
select event_id, problem, outcome, case when problem = 'too_large' then 413 when problem = 'invalid_request' then 400 when outcome = 'queue_rejected' or err = 'rate_limited' then 429
  when outcome = 'cancelled' then 499 when outcome = 'timeout' then 504 when outcome = 'provider_error' then 502 else 200 end as status,
  case when took >= 60000 then 'stream' end as late_in, case when took <= 5000 then 'queue' when took <= 20000 then 'connect' when took <= 40000 then 'first_byte' else 'stream' end as phase from o"""
)
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: validation, outcome, status and where a late one stood."""
    e, kind = F.col("event_id"), F.col("event_type")
    text = F.repeat(F.lit("x"), ((e * 37) % 12_000).cast("int"))
    fmt = F.element_at(F.array(*map(F.lit, ("mp3", "wav", "opus", "mp3", "flv"))), (e % 5 + 1).cast("int"))
    took = F.floor(F.col("value") * 700).cast("long")
    err = F.when(kind == "error", F.when(e % 3 == 0, "provider_timeout").when(e % 3 == 1, "rate_limited").otherwise("provider_unavailable"))
    rows = table(spark, sf_dir, "events").select("event_id", kind, requests.request_problem(text, F.col("value") / 50, fmt).alias("problem"), err.alias("err"), took.alias("took"))
    end = requests.outcome(F.col("problem"), kind == "signup", kind == "view", kind == "click", F.col("err"), F.col("took"))
    rows = rows.withColumn("outcome", end)
    return rows.select(
        "event_id", "problem", "outcome", requests.status_code(F.col("problem"), F.col("outcome"), F.col("err")).alias("status"), requests.deadline(F.col("took")).alias("late_in"),
        requests.phase_by_elapsed(F.col("took")).alias("phase"),
    )


@query(
    """
with s as (select event_id, (['empty', 'loading', 'extracting', 'ready', 'error'])[event_id % 5 + 1] as raw, (['idle', 'playing', 'paused', 'ended', 'error'])[(event_id // 5) % 5 + 1] as player,
  (event_id // 25) % 2 = 1 as preparing, (event_id // 50) % 2 = 1 as first_ready, (event_id // 100) % 2 = 1 as queued, (event_id // 200) % 4 = 3 as exporting, (event_id // 800) % 4 = 3 as failed from events)
select event_id, case when exporting then 'exporting' when failed and raw not in ('extracting', 'loading') then 'error' when raw in ('empty', 'loading', 'extracting') then raw
  when player = 'playing' then 'playing' when player = 'ended' then 'ready' when player = 'paused' then 'paused' when player = 'error' then 'error'
  when raw = 'ready' and preparing then 'preparing' when raw = 'ready' and first_ready and not queued then 'ready' when raw = 'ready' then 'preparing' else 'ready' end as phase from s"""
)
def reader_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of document, player and preparation states, by event number."""
    e = F.col("event_id")
    bit = lambda by, of=2: F.floor(e / by) % of == of - 1
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    raw, player = pick(("empty", "loading", "extracting", "ready", "error"), e % 5), pick(("idle", "playing", "paused", "ended", "error"), F.floor(e / 5) % 5)
    phase = requests.reader_phase(raw, player, bit(25), bit(50), bit(100), bit(200, 4), F.when(bit(800, 4), "broken"))
    return table(spark, sf_dir, "events").select("event_id", phase.alias("phase"))


@query(
    """
with m as (select item_id, encode('{"id":' || item_id || ',"n":' || length(text) || '}') as meta, encode(text) as audio from benchmark where text is not null)
select item_id, sha256(from_hex(printf('%02x', octet_length(meta) % 256) || printf('%02x', octet_length(meta) // 256) || '0000') || meta || audio) as frame_sha256,
  decode(meta) as metadata, octet_length(audio) as audio_bytes, NULL::varchar as problem from m"""
)
def audio_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary envelopes of metadata and bytes, built and read back."""
    meta = F.to_json(F.struct(F.col("item_id").alias("id"), F.length("text").alias("n")))
    framed = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", requests.frame(meta, meta, F.encode("text", "UTF-8")).alias("frame"))
    back = framed.select("item_id", F.sha2("frame", 256).alias("frame_sha256"), requests.parse_frame(F.col("frame")).alias("p"))
    return back.select("item_id", "frame_sha256", F.col("p.metadata").alias("metadata"), F.octet_length("p.audio").cast("long").alias("audio_bytes"), F.col("p.problem").alias("problem"))


@query("""select item_id, base64(encode('[{"text":"w","offset":' || item_id || '}]')) as header from benchmark""")
def boundary_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(F.struct(F.lit("w").alias("text"), F.col("item_id").alias("offset")))
    return table(spark, sf_dir, "benchmark").select("item_id", requests.header_json(words).alias("header"))


@query(
    """
select conv_id, turn, conv_id || ',' || turn || ',' || coalesce(role, '') || ',' ||
  case when regexp_matches(coalesce(text, ''), '[",\\n]') then '"' || replace(text, '"', '""') || '"' else coalesce(text, '') end as line from conversations"""
)
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", requests.csv_line(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")).alias("line"))


@query("""select page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as escaped_sha256, (page_id * 12345677) / 10000000 as seconds from pages""")
def markup_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.sha2(requests.escape_markup(F.col("html")), 256).alias("escaped_sha256"), requests.ticks_to_seconds(F.col("page_id") * 12_345_677).alias("seconds"))


@query("""select event_id, '{"ts":"t","level":"info","msg":"' || event_type || '","user":' || user_id || case when event_type = 'error' then ',"code":"provider_error"' else '' end || '}' as line from events""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "error", "provider_error").alias("code")
    return table(spark, sf_dir, "events").select("event_id", requests.log_line(F.lit("t"), F.lit("info"), F.col("event_type"), F.col("user_id").alias("user"), code).alias("line"))


@query(
    """
select conv_id, turn, regexp_matches(coalesce(text, '') || case when turn % 3 = 0 then ' Fila 1' else '' end, '(^|\\s)(Fila|Row)\\s') or role = 'system' as table_mark,
  regexp_matches(coalesce(text, '') || case when turn % 2 = 0 then ' Nota 3: x' else '' end, ' Nota [0-9]+:') as note_mark from conversations"""
)
def segment_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns read a table or a note, by type or by words."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    kind = F.when(F.col("role") == "system", "table-cell").otherwise("paragraph")
    row = F.concat("text", F.when(F.col("turn") % 3 == 0, " Fila 1").otherwise(""))
    note = F.concat("text", F.when(F.col("turn") % 2 == 0, " Nota 3: x").otherwise(""))
    return turns.select("conv_id", "turn", requests.marks_table(row, kind).alias("table_mark"), requests.marks_footnote(note, kind).alias("note_mark"))


# --- caches and logs --------------------------------------------------------------------------------


@query(
    """
with c as (select sha256(text) as k, min(conv_id) as conv_id from conversations where role = 'assistant' and text is not null group by 1)
select sha256(text) as cache_key, min(turn) as first_turn, count(*) as requests from conversations where text is not null and sha256(text) not in (select k from c) group by 1"""
)
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to synthesise: those whose content key the cache (the assistant's turns) lacks, once each."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("cache_key", F.sha2("text", 256))
    return serving.cache_misses(turns, turns.where("role = 'assistant'"), "cache_key", "turn").select("cache_key", F.col("first").alias("first_turn"), "requests")


@query("select event_id, coalesce(case when event_type in ('view', 'click') then event_type end, 'default') as engine from events")
def engine_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested engines to those there are; unknown ones take the first."""
    engines = spark.createDataFrame([(0, "default"), (1, "view"), (2, "click")], "place int, engine string")
    return serving.engine_for(table(spark, sf_dir, "events").withColumnRenamed("event_type", "wanted"), engines).select("event_id", "engine")


@query(
    """
select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by 1"""
)
def positions_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored positions (all but the last quarter of the log) and later saves: the later save of a key stays."""
    log = events(spark, sf_dir)
    cut = log.agg((F.max("event_id") * 3 / 4).alias("cut"))
    both = log.join(F.broadcast(cut))  # one row
    stored = serving.upsert(both.where("event_id <= cut").drop("cut"), both.where("event_id > cut").drop("cut"), "user_id", F.struct("ms", "event_id"))
    return stored.select("user_id", "event_id", "value")


@query(
    """
select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as place from
  (select *, max(ts) over () as now from events) where epoch_us(now) // 1000 - epoch_us(ts) // 1000 <= 7776000000 // 30"""
)
def positions_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unexpired positions of a user, latest first (three days, of a log of a month)."""
    log = events(spark, sf_dir)
    now = log.agg(F.max("ms").alias("now"))
    live = serving.alive(log.join(F.broadcast(now)), "ms", F.col("now"), 7_776_000_000 // 30)  # now is one row
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ms"), F.desc("event_id")))
    return live.select("user_id", "event_id", place.cast("long").alias("place"))


@query(
    """
with n as (select *, max(epoch_us(ts) // 1000) over () as now, epoch_us(ts) // 1000 as ms from events),
o as (select user_id, event_id, row_number() over (partition by user_id order by ms, event_id) as r, ms, now from n)
select user_id, event_id from o where r <= 20 and ms < now - 864000000"""
)
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one bounded pass removes: of the oldest entries those that have expired."""
    log = events(spark, sf_dir)
    now = log.agg(F.max("ms").alias("now"))
    return serving.prune(log.join(F.broadcast(now)), "user_id", "ms", "event_id", F.col("now"), 864_000_000, 20).select("user_id", "event_id")  # now is one row


@query(
    """
with e as (select user_id, event_id, ts, floor(value * 10)::bigint // 200 as epoch from events),
m as (select *, max(epoch) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as top from e)
select user_id, event_id, epoch = top as kept from m"""
)
def stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of an epoch that a later one has overtaken are dropped."""
    log = events(spark, sf_dir).withColumn("epoch", F.floor(F.floor(F.col("value") * 10) / 200).cast("long"))
    return serving.current_epoch(log, "user_id", "epoch", F.struct("ms", "event_id")).select("user_id", "event_id", "kept")


@query(
    """
with l as (select event_type, event_id, case event_id % 4 when 0 then 'local' when 1 then 'server' else 'none' end as cache, event_type = 'error' and event_id % 4 <> 0 as failed, floor(value * 10)::bigint as wait from events)
select event_type, count(case when cache <> 'local' and not failed then 1 end) as requests, count(case when cache = 'local' then 1 end) as local_hits, count(case when cache = 'server' then 1 end) as server_hits,
  count(case when failed then 1 end) as errors, count(case when wait > 250 then 1 end) as underruns from l group by 1"""
)
def player_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, hits, errors and underruns of a playback log by kind of event."""
    from plectrum.operators.evaluation import player_report

    k = F.col("event_id") % 4
    log = table(spark, sf_dir, "events").select(
        "event_type", F.col("event_id").alias("at"), F.when(k == 0, "local").when(k == 1, "server").otherwise("none").alias("cache"),
        F.when((F.col("event_type") == "error") & (k != 0), "provider_error").alias("error"), F.floor(F.col("value") * 10).cast("long").alias("wait_ms"), F.lit(1).alias("took_ms"),
    )
    return player_report(log, "event_type").drop("latencies_ms")


@query(
    """
with a as (select user_id, event_id, epoch_us(ts) // 1000 as ms, floor(value * 20000)::bigint as horizon from events),
w as (select *, lag(ms + horizon) over (partition by user_id order by ms, event_id) as before from a)
select user_id, count(case when before < ms then 1 end) as rebuffers, coalesce(sum(case when before < ms then ms - before end), 0)::bigint as frozen_ms from w group by 1"""
)
def rebuffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and how long playing stood still because the next audio came after the horizon."""
    log = events(spark, sf_dir).withColumn("length_ms", F.floor(F.col("value") * 20_000).cast("long"))
    return serving.rebuffers(log, "user_id", F.struct("ms", "event_id"), "ms", "length_ms")


@query(
    f"""
with {oracle.LISTEN_TIMED}, u as (select conv_id, turn, case when turn % 5 <> 3 then duration end as duration, gap from timed),
x as (select *, coalesce(sum(coalesce(duration, 0) + gap) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as start from u),
p as (select conv_id, turn * 2.5::double as time from conversations)
select p.conv_id, p.time, min(x.turn) as chunk from p left join x on x.conv_id = p.conv_id and (x.duration is null or p.time < x.start + (x.duration + x.gap)) group by 1, 2"""
)
def active_chunk_partly_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn that sounds at each time while every fifth turn is still to come: the first of these holds all times after its start."""
    from plectrum.plans.registry import timed

    known = timed(spark, sf_dir).withColumn("duration", F.when(F.col("turn") % 5 != 3, F.col("duration"))).drop("start")
    placed = serving.timeline(known, "conv_id", "turn", "duration", "gap").withColumn("chunk", F.col("turn"))
    points = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 2.5).alias("time"))
    return serving.chunk_at(points, placed, "conv_id", "time", "start", F.col("duration") + F.col("gap")).distinct()


@query("select doc_id, substr(text, 1, 30) as p30, substr(text, 1, 60) as p60, substr(text, 1, 80) as p80, substr(sha256(text), 1, 12) as key12 from documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortened texts and key of reports and logs."""
    shown = [navigation.head_units(F.col("text"), n).alias(f"p{n}") for n in (30, 60, 80)]
    return table(spark, sf_dir, "documents").select("doc_id", *shown, F.substring(F.sha2("text", 256), 1, 12).alias("key12"))
