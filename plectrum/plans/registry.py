"""Named queries over the driver tables and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plectrum.functions import language, spanish
from plectrum.functions.fidelity import critical_tokens
from plectrum.functions.text import fingerprint, log_fingerprint, normalized, units
from plectrum.operators import chunks, metrics, navigation, plan, serving, tables
from plectrum.plans import files, oracle, playback, reports, spoken, streams
from plectrum.plans.shared import Query, events, table
from plectrum.sources import html, markdown, text

def segments(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    # a plan needs a document's blocks together: dealt out first, all its work has the cluster's width and no second exchange
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return plan.listen_plan(text.text_blocks(docs), only=only)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listen plan of every document as speech chunks."""
    return chunks.plan_chunks(segments(spark, sf_dir), 400, 200)


def listen_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select(
        "doc_id", "segment_id", "spoken_text", F.size("transformations").cast("long").alias("n_transformations"), "fidelity_ok", "fallback", "muted"
    )


def literal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return plan.literal_plan(text.text_blocks(docs)).select("doc_id", "segment_id", "spoken_text", "muted")


def plan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan.plan_stats(segments(spark, sf_dir))
    return out.withColumn("rule_hits", F.to_json("rule_hits"))


def doc_blocks_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.text_blocks(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("ord").cast("long").alias("ord"), "text", "source_ref")


def chrome_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as blocks: a user's log as a document, a day as a page, the kind and hour as the text."""
    log = events(spark, sf_dir)
    text = F.concat(F.lit(" "), F.initcap("event_type"), F.lit("  "), (F.floor(F.col("ms") / 3_600_000) % 8).cast("string"))
    blocks = log.select(F.col("user_id").alias("doc_id"), F.floor(F.col("ms") / 86_400_000).alias("page"), F.col("event_id").alias("ord"), text.alias("text"), F.when(F.col("event_type") == "error", "heading").otherwise("paragraph").alias("type"))
    return plan.repeated_chrome(blocks).where("chrome").select("doc_id", "ord", "text")


def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as page lines of five shapes; three of them are page numbers."""
    n, k = F.col("l_linenumber").cast("string"), F.col("l_partkey")
    pages = (k % 10_000).cast("string")  # a count of pages has four digits at most
    shapes = (n, F.concat(F.lit(" Pág. "), n, F.lit(" de "), pages), F.concat(n, F.lit(" - "), n), F.concat(F.lit("page "), n), F.concat(n, F.lit(" de 12345")))
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.get(F.array(*shapes), (k % 5).cast("int")).alias("text"))
    return lines.where(plan.is_page_number(F.col("text"))).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    es, en = language.scores(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", es.alias("es_score"), en.alias("en_score"), F.when(es >= en, "es").otherwise("en").alias("detected"))


def lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_detect(spark, sf_dir).groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


def dice_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return metrics.dice_pairs(docs, items, 0.55)


def dice_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before it in its conversation."""
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    step = turns.withColumn("before", before).where("before IS NOT NULL")
    d = metrics.dice(F.col("before"), F.col("text"))
    return step.select("conv_id", "turn", metrics.rounded(d, 4).alias("dice"))


def exact_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents one of whose lines stands, up to case and blanks, in a document of another language."""
    lines = text.line_blocks(table(spark, sf_dir, "documents")).where("text <> ''").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    keyed = lines.select("doc_id", "lang", normalized(F.col("text")).alias("key")).where("key <> ''")
    many = keyed.groupBy("key").agg(F.count_distinct("lang").alias("n")).where("n > 1")
    return keyed.join(many, "key", "left_semi").select("doc_id").distinct()


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation matched one to one with the turns after them."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    a, b = turns.select("doc_id", F.col("turn").alias("ref"), F.col("text").alias("x")), turns.select("doc_id", F.col("turn").alias("got"), F.col("text").alias("y"))
    pairs = a.join(b, "doc_id").where("ref < got")  # a conversation's turns are few
    scored = pairs.select("doc_id", "ref", "got", metrics.dice(F.col("x"), F.col("y")).alias("dice"))
    return metrics.greedy_match(scored, 0.3)


def pctl_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    events_ = table(spark, sf_dir, "events")
    found = metrics.upper_percentiles(events_, "value", (0.5, 0.95), "event_type")
    return found.groupBy("event_type").agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95"))


def mode_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("place", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return metrics.mode_first(lines, F.col("l_quantity"), "place", "l_returnflag")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).withColumn("s", F.floor(F.col("ms") / 1000).cast("long"))
    out = serving.rate_limit(log, "user_id", "s", "event_id", 1, 3600)
    return out.select("event_id", "window_start", "place", "allowed", "retry_after_s")


def pacing_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serving.pacing_starts(events(spark, sf_dir), "user_id", "ms", "event_id", 15)
    return out.select("event_id", "start_ms", "wait_ms")


def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = events(spark, sf_dir).withColumn("size", (F.col("event_id") % 1000 + 1).cast("long"))
    return serving.evict(entries, "user_id", "size", "ms", "event_id", 10_000).select("event_id", "user_id", F.col("kept_bytes").cast("long").alias("kept_bytes"))


def ttl_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last day before the table's own latest time."""
    log = events(spark, sf_dir)
    now = log.agg(F.max("ms").alias("now"))
    return serving.alive(log.join(F.broadcast(now)), "ms", F.col("now"), 86_400_000).select("event_id")  # now is one row


def recents_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serving.top_recent(events(spark, sf_dir), "user_id", "ms", "event_id", 5)
    return out.select("user_id", F.col("place").cast("long").alias("place"), "event_id")


def positions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ms", "event_id")
    out = serving.latest(events(spark, sf_dir), "user_id", order, "event_type", "value")
    return out.select("user_id", F.col("at.event_id").alias("event_id"), "event_type", "value")


def inflight_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthesis a distinct text: content key, first document, requests saved."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    key = F.sha2("text", 256).alias("content_key")
    return docs.groupBy(key).agg(F.min("doc_id").alias("first_doc"), (F.count(F.lit(1)) - 1).alias("saved"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.line_blocks(table(spark, sf_dir, "documents")).where("text <> ''")
    return metrics.stratified_sample(lines, "text", ["doc_id", "ord"], 40).select("stratum", "doc_id", F.col("ord").cast("long").alias("ord"), "text")


def mock_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = units(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_units"), F.least(F.lit(3.0), F.greatest(F.lit(1.0), n * F.lit(0.01))).alias("seconds"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.concat(F.lit("doc-"), fingerprint(F.col("text"))).alias("document"), log_fingerprint(F.col("text")).alias("logged"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of the compact settings record; texts are JSON strings."""
    record = F.concat(
        F.lit('{"t":'), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2),
        F.lit(',"p":"mock","m":"m","v":"v","s":1,"f":"wav","e":"1.1.0"}'),
    )
    items = table(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    return items.select("item_id", F.sha2(record, 256).alias("cache_key"))


def es_cardinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", spanish.integer_words(F.col("o_orderkey").cast("string")).alias("words"))


def currency_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as money texts, verbalised by the rule chain."""
    from plectrum.functions.rules import RULES, apply_rules

    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    whole = F.regexp_replace(F.reverse(F.regexp_replace(F.reverse(F.floor(cents / 100).cast("string")), r"(\d{3})(?=\d)", "$1.")), "^$", "0")
    money = F.concat(whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", money.alias("text"))
    return apply_rules(rows, "text", tuple(r for r in RULES if r.id == "currencies")).select("o_orderkey", F.col("spoken").alias("words"))


def date_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = F.col("l_shipdate")
    words = spanish.date_words(F.date_format(ship, "d"), F.date_format(ship, "M"), F.date_format(ship, "yyyy"))
    return table(spark, sf_dir, "lineitem").groupBy(words.alias("words")).agg(F.count(F.lit(1)).alias("n"))


def ordinal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber").cast("string")
    rows = table(spark, sf_dir, "lineitem").select(spanish.ordinal_word(number, F.col("l_returnflag") == "R").alias("words"))
    return rows.groupBy("words").agg(F.count(F.lit(1)).alias("n"))


def toc_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn opens a contents entry; each turn finds the last entry not after it."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "role")
    toc = turns.where("ord % 3 = 1").select("doc_id", F.col("ord").alias("pos"), F.col("ord").alias("block_index"), F.concat("role", F.lit("-"), F.col("ord").cast("string")).alias("label"))
    return navigation.active_entry(turns, toc).select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), "label")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    n = units(F.coalesce("text", F.lit("")))
    last = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).isNull()
    word = F.element_at(F.split("text", " "), -1)
    step = turns.select(
        "conv_id", "turn", F.least(F.lit(3.0), F.greatest(F.lit(1.0), n * F.lit(0.01))).alias("duration"), serving.gap_after(word, last).alias("gap")
    )
    return serving.timeline(step, "conv_id", "turn", "duration", "gap")


def timeline_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spark, sf_dir).select("conv_id", "turn", "gap", metrics.rounded(F.col("start"), 3).alias("start"))


def active_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turn sounds at each two and a half seconds of a conversation."""
    placed = timed(spark, sf_dir).withColumn("chunk", F.col("turn"))
    points = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 2.5).alias("time"))
    return serving.chunk_at(points, placed, "conv_id", "time", "start", F.col("duration") + F.col("gap"))


def timeline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spark, sf_dir).groupBy("conv_id").agg(metrics.rounded(F.sum(F.col("duration") + F.col("gap")), 3).alias("seconds"), F.count(F.lit(1)).alias("chunks"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as headings; two on one half-minute are one chapter."""
    heads = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.floor((F.col("turn") - 1) / 4).cast("long").alias("start"))
    return serving.chapters(heads).select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), "start")


def monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return metrics.monotonic(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ref"), F.length("text").alias("got")))


def table_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as a table of three columns, spoken."""
    nation = table(spark, sf_dir, "nation")
    cells = nation.select(
        F.col("n_regionkey").cast("long").alias("doc_id"),
        F.posexplode(F.array(F.col("n_name"), F.col("n_nationkey").cast("string"), F.lit("x"))).alias("level", "text"), (F.col("n_nationkey") * 3).alias("base"),
    )
    head = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.posexplode(F.array(F.lit("Name"), F.lit("Key"), F.lit("Mark"))).alias("level", "text"), F.lit(-3).alias("base"))
    blocks = cells.unionByName(head).select("doc_id", (F.col("base") + F.col("level")).alias("ord"), F.lit("table-cell").alias("type"), "text", "level", F.lit(1).alias("page"))
    said, _ = tables.speak_tables(blocks, blocks)
    return said.select("doc_id", "text")


def critical_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    each = docs.select("lang", F.explode(critical_tokens(F.coalesce("text", F.lit("")))).alias("t"))
    return each.groupBy("lang", F.col("t.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def speech_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of user and assistant turns of a conversation, and how far apart they are."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "user", F.length("text"))).alias("user_chars"), F.sum(F.when(F.col("role") == "assistant", F.length("text"))).alias("assistant_chars")
    )
    ratio = metrics.balance(F.coalesce("user_chars", F.lit(0)), F.coalesce("assistant_chars", F.lit(0)))
    return turns.select("conv_id", F.when(~F.isnan(ratio), ratio).alias("ratio"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_blocks(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content")))


def html_listen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages through the product plan."""
    return plan.product_plan(html_blocks(spark, sf_dir)).select("doc_id", "segment_id", "type", "spoken_text", "muted")


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.markdown_blocks(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")))


_QUERIES: tuple[Query, ...] = (
    listen_plan, literal_plan, plan_stats, doc_blocks_txt, chrome_repeat, page_number_lines, lang_detect, lang_confusion, dice_benchmark,
    dice_turns, exact_norm, greedy_match, pctl_floor, mode_first, rate_limit, pacing_starts, cache_evict, ttl_live, recents_top5,
    positions_latest, inflight_dedup, stratified_sample, mock_duration, fingerprints, cache_keys, es_cardinal, currency_words, date_words,
    ordinal_words, toc_asof, timeline_prefix, active_chunk, timeline_totals, chapters, monotonic, table_speech, critical_token_counts,
    speech_balance, html_blocks, html_listen, markdown_blocks,
)


_MODULES = (files, playback, reports, spoken, streams)


def queries() -> dict[str, Query]:
    found = {"chunk_pack": flagship} | {q.__name__: q for q in _QUERIES}
    for module in _MODULES:
        found |= module.REGISTERED.queries
    return found


def oracle_sql() -> dict[str, str]:
    found = oracle.sql()
    for module in _MODULES:
        found |= module.REGISTERED.sql
    return found
