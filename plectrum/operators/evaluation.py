"""Evaluation reports: independent fidelity checks, extraction and gold summaries, review packets, latency and burn metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plectrum.functions.fidelity import contains_at_boundary, critical_tokens, standing
from plectrum.functions.rules import RULES
from plectrum.functions.spanish import let
from plectrum.functions.text import normalized, rounded, word_tokens
from plectrum.operators.metrics import dice_of_groups, greedy_match
from plectrum.operators.plan import LAYOUT_NOISE, is_page_number
from plectrum.operators.ranks import percentiles
from plectrum.operators.similar import similar_pairs

# What a legal term or a rule stands for in the reports.
LEGAL_CATEGORY = {
    "deberá": "obligations", "podrá": "permissions", "no deberá": "negations", "no podrá": "negations", "salvo que": "exceptions", "excepto": "exceptions",
    "sin perjuicio de": "exceptions", "no obstante": "exceptions", "en ningún caso": "prohibitions", "queda prohibido": "prohibitions",
    "siempre que": "conditions", "antes de": "deadlines", "después de": "deadlines", "dentro de": "deadlines", "a más tardar": "deadlines",
}
RULE_CATEGORY = {
    "numbers": "numbers", "currencies": "monetary", "percentages": "percentages", "basis-points": "basis-points", "dates": "dates", "dates-iso": "dates",
    "dates-hyphen": "dates", "legal-references": "legal-references", "keyword-references": "legal-references", "roman-headings": "legal-references",
    "provision-abbrev": "legal-references", "isin": "identifiers", "lei": "identifiers", "ordinals": "ordinals", "time": "times", "settlement": "settlement",
    "ranges": "ranges",
}
PREVIEW = 80


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def of_types(blocks: DataFrame, *types: str) -> DataFrame:
    return blocks.where(F.col("type").isin(*types))


def content(blocks: DataFrame) -> DataFrame:
    """Blocks that are no page furniture."""
    return blocks.where(~F.col("type").isin(*LAYOUT_NOISE))


def muted_meaning(text: Column, muted_by: Column) -> Column:
    """The critical literal that muting a text silences against the rules, or null.

    Page numbers and furniture found by its place may carry numbers; nothing muted may carry a legal term or an identifier.
    """

    def of_tokens(tokens: Column) -> Column:
        of = lambda *kinds: F.filter(tokens, lambda t: t["kind"].isin(*kinds))
        meaningful, numbers = of("legal-term", "isin", "lei"), of("number", "ordinal")
        by_place = (muted_by == "layout-classification") & (F.size(of("legal-term")) == 0)
        harmless = is_page_number(text) | F.coalesce(by_place, F.lit(False))
        bad = (F.size(meaningful) > 0) | ((F.size(numbers) > 0) & ~harmless)
        return F.when(bad, F.coalesce(F.get(meaningful, F.lit(0))["text"], F.get(numbers, F.lit(0))["text"]))

    return let(critical_tokens(text), of_tokens)


_CHECK = "array<struct<kind:string,token:string,category:string>>"


def _checks() -> Column:
    """What an independent check finds in a segment's row, an entry a critical literal."""
    preserving = [r.id for r in RULES if r.value_preserving]
    spoken, source, records = F.col("spoken_text"), F.col("source_text"), F.col("transformations")
    entry = lambda kind, token, category: F.struct(kind.alias("kind"), token.alias("token"), category.alias("category"))
    none = F.lit(None).cast("string")

    def kept(t: Column, said: Column) -> Column:
        def told(covering: Column) -> Column:
            covered = F.exists(covering, lambda r: r["rule"].isin(*preserving))
            legal, verbatim = t["kind"] == "legal-term", F.array_contains(said, t["text"]) | contains_at_boundary(spoken, t["text"])
            category = (
                F.when(legal & verbatim, F.coalesce(_lookup(LEGAL_CATEGORY, t["text"]), F.lit("legal-terms")))
                .when(~legal & verbatim, F.concat(t["kind"], F.lit("-verbatim")))
                .when(~legal & covered, F.coalesce(_lookup(RULE_CATEGORY, F.get(covering, F.lit(0))["rule"]), t["kind"]))
            )
            return let(category, lambda c: entry(F.when(c.isNull(), "lost").otherwise("preserved"), t["text"], c))

        return let(F.filter(records, lambda r: contains_at_boundary(r["source"], t["text"])), told)

    def known(t: Column, there: Column) -> Column:
        return F.array_contains(there, t["text"]) | contains_at_boundary(source, t["text"]) | F.exists(records, lambda r: contains_at_boundary(r["replacement"], t["text"]))

    def both(x: Column) -> Column:
        invented = F.filter(x["after"], lambda t: ~known(t, x["there"]))
        return F.concat(F.transform(x["before"], lambda t: kept(t, x["said"])), F.transform(invented, lambda t: entry(F.lit("invented"), t["text"], none)))

    def told(before: Column) -> Column:
        after = F.when(source == spoken, before).otherwise(critical_tokens(spoken))  # most texts are read as they stand
        return F.struct(before.alias("before"), after.alias("after"))

    stand = lambda y: F.struct(y["before"].alias("before"), y["after"].alias("after"), standing(y["before"]).alias("there"), standing(y["after"]).alias("said"))
    heard = let(let(let(critical_tokens(source), told), stand), both)
    silent = let(muted_meaning(source, F.col("muted_by")), lambda m: F.when(m.isNotNull(), F.array(entry(F.lit("muted-meaning"), m, none))))
    return F.coalesce(F.when(F.col("muted"), silent).otherwise(heard), F.array().cast(_CHECK))


def recheck(segments: DataFrame) -> DataFrame:
    """doc_id, segment_id, kind, token, category of every critical literal, recomputed from the segments alone.

    kind: preserved (with its category), lost, invented or muted-meaning.  The runtime's own verdict is not trusted.
    """
    return segments.select("doc_id", "segment_id", F.inline(_checks()))


def fidelity_report(segments: DataFrame) -> DataFrame:
    """One row a document: segments, muted, fallbacks, preserved (category to count), violations and pass; one pass."""
    each = segments.select("doc_id", "muted", "fallback", _checks().alias("c"))
    kept = F.flatten(F.collect_list(F.transform(F.filter("c", lambda x: x["kind"] == "preserved"), lambda x: x["category"])))
    own = each.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if("muted").alias("muted"), F.count_if("fallback").alias("fallbacks"), kept.alias("_kept"),
        F.sum(F.size(F.filter("c", lambda x: x["kind"] != "preserved"))).alias("violations"),
    )
    names = F.array_sort(F.array_distinct("_kept"))
    counts = F.transform(names, lambda n: F.size(F.filter("_kept", lambda k: k == n)))  # some twenty categories
    return own.select("doc_id", "segments", "muted", "fallbacks", F.map_from_arrays(names, counts).alias("preserved"), "violations", (F.col("violations") == 0).alias("pass"))


# --- extraction -------------------------------------------------------------------------------------


def scored_pairs(reference: DataFrame, extracted: DataFrame) -> DataFrame:
    """doc_id, ref, got, dice of a document's content blocks that may match.

    Blocks without a word are alike and match in order, so the k-th meets the k-th alone.
    """
    a = content(reference).select("doc_id", F.col("ord").cast("long").alias("id"), "text")
    b = content(extracted).select("doc_id", F.col("ord").cast("long").alias("id"), "text")
    found = similar_pairs(a, b, 0.55, ["doc_id"]).select("doc_id", F.col("left_id").alias("ref"), F.col("right_id").alias("got"), "dice")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))
    bare = lambda df, name: df.where(F.size(word_tokens(F.coalesce("text", F.lit("")))) == 0).select("doc_id", F.col("id").alias(name), place.alias("_k"))
    empty = bare(a, "ref").join(bare(b, "got"), ["doc_id", "_k"]).select("doc_id", "ref", "got", F.lit(1.0).alias("dice"))
    return found.unionByName(empty)


def extraction_report(reference: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row a document: how much of the reference's structure an extraction has kept.

    reference, extracted: doc_id, ord, type, text, page; extracted may have box.
    """
    matches = greedy_match(scored_pairs(reference, extracted))
    ref = content(reference).select("doc_id", F.col("ord").cast("long").alias("ref"), F.col("type").alias("ref_type"), F.col("page").alias("ref_page"), "text")
    got = extracted.select("doc_id", F.col("ord").cast("long").alias("got"), F.col("type").alias("got_type"), F.col("page").alias("got_page"))
    each = ref.join(matches, ["doc_id", "ref"], "left").join(got, ["doc_id", "got"], "left")
    hit = F.col("got").isNotNull()
    before = F.last("got", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ref").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("_step", F.col("got") - before)
    right = lambda t: F.count_if(hit & (F.col("ref_type") == t) & (F.col("got_type") == t)).alias(t.replace("-", "_") + "_recovered")
    there = lambda t: F.count_if(F.col("ref_type") == t).alias(t.replace("-", "_") + "_reference")
    typed = [f(t) for t in ("heading", "list-item", "footnote", "table-cell") for f in (there, right)]
    per_doc = each.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("reference_blocks"), rounded(F.count_if(hit) / F.greatest(F.lit(1), F.count(F.lit(1))), 3).alias("content_recall"),
        F.when(F.count_if(hit) > 0, rounded(F.count_if(hit & (F.col("ref_page") == F.col("got_page"))) / F.count_if(hit), 3)).alias("page_accuracy"),
        F.count_if(~hit).alias("missed"), F.count_if(hit & (F.col("ref_type") != F.col("got_type"))).alias("misclassified"), (F.coalesce(F.min("_step"), F.lit(0)) >= 0).alias("in_order"), *typed,
    )
    text = dice_of_groups(content(reference), content(extracted), "doc_id").select("doc_id", rounded(F.col("dice"), 3).alias("text_fidelity"))
    boxed = F.col("box").isNotNull() if "box" in extracted.columns else F.lit(False)
    covered = extracted.groupBy("doc_id").agg(rounded(F.count_if((F.col("page") >= 1) & boxed) / F.count(F.lit(1)), 3).alias("provenance_coverage"))
    out = per_doc.join(text, "doc_id").join(covered, "doc_id", "left").join(chrome_report(reference, extracted), "doc_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chrome_reference", "chrome_recovered")} | {"provenance_coverage": F.coalesce("provenance_coverage", F.lit(0.0))})


def chrome_report(reference: DataFrame, extracted: DataFrame) -> DataFrame:
    """chrome_reference and chrome_recovered a document: furniture whose normalised text some extracted furniture has."""
    key = normalized(F.col("text"))
    ref = of_types(reference, *LAYOUT_NOISE).select("doc_id", key.alias("key"))
    got = of_types(extracted, *LAYOUT_NOISE).select("doc_id", key.alias("key"), F.lit(True).alias("there")).distinct()
    return ref.join(got, ["doc_id", "key"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chrome_reference"), F.count_if("there").alias("chrome_recovered"))


def extraction_summary(reports: DataFrame) -> DataFrame:
    """Means of the rounded figures and sums over all documents."""
    return reports.agg(
        rounded(F.coalesce(F.avg("text_fidelity"), F.lit(0.0)), 3).alias("mean_text_fidelity"), rounded(F.coalesce(F.avg("content_recall"), F.lit(0.0)), 3).alias("mean_content_recall"),
        F.count_if(~F.col("in_order")).alias("order_failures"), F.coalesce(F.sum("table_cell_recovered"), F.lit(0)).alias("tables_detected"),
        F.coalesce(F.sum("table_cell_reference"), F.lit(0)).alias("tables_present"),
    )


# --- gold -------------------------------------------------------------------------------------------


def gold_segments(gold: DataFrame, segments: DataFrame) -> DataFrame:
    """Gold entries (doc_id, block_id, gold_text) with the first segment whose first block is theirs; others drop out.

    segments: doc_id, ord, segment_id, block_id (its first), spoken_text.
    """
    first = segments.groupBy("doc_id", "block_id").agg(F.min_by(F.struct("segment_id", "spoken_text"), "ord").alias("s"))
    return gold.join(first, ["doc_id", "block_id"]).select("doc_id", "block_id", "gold_text", "s.segment_id", "s.spoken_text")


def gold_pairs(gold: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, entry, block_id, literal_text, gold_text where the two differ; an entry without a block is an error."""
    hit = gold.join(blocks.select("doc_id", "block_id", F.col("text").alias("literal_text")), ["doc_id", "block_id"], "left")
    there = F.when(F.col("literal_text").isNull(), F.raise_error(F.concat(F.lit("gold entry references unknown block "), F.col("block_id")))).otherwise(F.col("literal_text"))
    from plectrum.functions.text import trim

    out = hit.select("doc_id", "entry", "block_id", there.alias("literal_text"), "gold_text")
    return out.where(trim(F.col("gold_text")) != trim(F.col("literal_text")))


def capture_ratio(listen: Column, literal: Column, gold: Column) -> Column:
    """How much of the way from the literal to the gold score a rendering goes."""
    return F.when(gold != literal, (listen - literal) / (gold - literal))


# --- review packets ---------------------------------------------------------------------------------


def review_packet(segments: DataFrame) -> DataFrame:
    """Heard segments that rules changed and kept: id, origin, construction_classes, source and spoken text, transformations."""
    own = segments.where(~F.col("muted") & ~F.col("fallback") & (F.size("transformations") > 0))
    each = F.transform("transformations", lambda t: F.concat(t["rule"], F.lit("["), t["source"], F.lit(" -> "), t["replacement"], F.lit("]")))
    return own.select(
        F.concat(F.lit("corpus:"), F.col("doc_id").cast("string"), F.lit(":"), "segment_id").alias("id"), F.lit("corpus").alias("origin"),
        F.array_join(F.array_distinct(F.transform("transformations", lambda t: t["rule"])), ",").alias("construction_classes"),
        "source_text", "spoken_text", F.array_join(each, " | ").alias("transformations"),
    )


def class_histogram(packet: DataFrame) -> DataFrame:
    """class, n, the most frequent first."""
    return packet.select(F.explode(F.split("construction_classes", ",")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class")


# --- latency ----------------------------------------------------------------------------------------


def request_report(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row a request with its waits, retries and factors; null where there is nothing to measure.

    requests: request_id, enqueued_ms, ended_ms, ok, audio_ms; attempts: request_id, attempt, start_ms, end_ms, ok, status, first_ms.
    """
    w = Window.partitionBy("request_id").orderBy("attempt")
    step = attempts.withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(w))
    per = step.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.min_by("start_ms", "attempt").alias("first_start"), F.max_by(F.col("end_ms") - F.col("start_ms"), F.when(F.col("ok"), F.col("attempt"))).alias("wire_ms"),
        F.min_by("first_ms", F.when(F.col("attempt") == 1, F.col("attempt"))).alias("first_attempt_ttfa_ms"), F.max_by("first_ms", F.when(F.col("ok"), F.col("attempt"))).alias("ttfa_ms"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("attempt", "gap")))), lambda x: x["gap"]).alias("backoff_gaps_ms"),
        F.transform(F.sort_array(F.collect_list(F.struct("attempt", "status"))), lambda x: x["status"]).alias("status_codes"),
    )
    hit = requests.join(per, "request_id", "left")
    wire = F.when(F.col("ok"), F.col("wire_ms"))
    return hit.select(
        "request_id", "ok", (F.col("ended_ms") - F.col("enqueued_ms")).alias("total_ms"), (F.col("first_start") - F.col("enqueued_ms")).alias("queue_wait_ms"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), (F.coalesce("attempts", F.lit(0)) - 1).alias("retries"), "backoff_gaps_ms", "wire_ms", "first_attempt_ttfa_ms", "ttfa_ms", "status_codes",
        F.when(F.col("ok"), F.col("audio_ms")).alias("audio_ms"), F.when((F.col("audio_ms") > 0) & (wire > 0), rounded(wire / F.col("audio_ms"), 3)).alias("rtf"),
    )


def run_report(requests: DataFrame) -> DataFrame:
    """Counts, sums and upper percentiles over the rows of request_report."""
    good = requests.where("ok")
    sums = requests.agg(
        F.count(F.lit(1)).alias("requested"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.sum("retries").alias("retries"), F.sum("attempts").alias("wire_requests"),
        F.sum(F.size(F.filter("status_codes", lambda s: s == 429))).alias("count_429"), (F.coalesce(F.sum("audio_ms"), F.lit(0)) / 1000).alias("audio_seconds"),
    )
    wanted = (("ttfa_p50", "ttfa_ms", 0.5), ("ttfa_p95", "ttfa_ms", 0.95), ("wire_p50", "wire_ms", 0.5), ("wire_p95", "wire_ms", 0.95), ("total_p50", "total_ms", 0.5), ("queue_wait_p95", "queue_wait_ms", 0.95), ("rtf_p50", "rtf", 0.5))
    shares: dict[str, tuple[float, ...]] = {}
    for _, value, p in wanted:
        shares[value] = (*shares.get(value, ()), p)
    at = lambda value, p: F.max(F.when((F.col("name") == value) & (F.col("p") == p), F.col("value"))).cast(requests.schema[value].dataType)
    one = percentiles(good, shares).agg(*[at(value, p).alias(name) for name, value, p in wanted])
    return sums.join(F.broadcast(one), how="left")  # one row each


def burn_report(requests: DataFrame, attempts: DataFrame, *by: str) -> DataFrame:
    """A sustained run: successes, wire-level refusals, latency bounds and the effective rate a minute.

    requests: by, request_id, start_ms, end_ms, ok; attempts: by, status.
    """
    own = requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.min(F.when(F.col("ok"), F.col("end_ms") - F.col("start_ms"))).alias("latency_min_ms"),
        F.max(F.when(F.col("ok"), F.col("end_ms") - F.col("start_ms"))).alias("latency_max_ms"), (F.max("end_ms") - F.min("start_ms")).alias("wall_ms"),
    )
    wire = attempts.groupBy(*by).agg(F.count(F.lit(1)).alias("wire_requests"), F.count_if(F.col("status") == 429).alias("count_429"), F.count_if(F.col("status") >= 500).alias("count_5xx"))
    out = own.join(wire, list(by), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("wire_requests", "count_429", "count_5xx")})
    rate = F.when(F.col("wall_ms") > 0, F.floor(F.col("requests") / F.col("wall_ms") * 60_000 + 0.5)).otherwise(F.col("requests") * 60).cast("long")
    return out.withColumns({"retries": F.greatest(F.lit(0), F.col("wire_requests") - F.col("requests")), "per_minute": rate})


def player_report(log: DataFrame, *by: str) -> DataFrame:
    """requests, hits, errors, underruns (waits above 250 ms) and latencies in order from a player's log (at, cache, error, wait_ms, took_ms)."""
    asked = F.col("cache") != "local"
    return log.groupBy(*by).agg(
        F.count_if(asked & F.col("error").isNull()).alias("requests"), F.count_if(F.col("cache") == "local").alias("local_hits"), F.count_if(F.col("cache") == "server").alias("server_hits"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("wait_ms") > 250).alias("underruns"),
        F.transform(F.sort_array(F.collect_list(F.when(asked & F.col("error").isNull(), F.struct("at", "took_ms")))), lambda x: x["took_ms"]).alias("latencies_ms"),
    )
