"""Spoken plans over block tables (doc_id, ord, type, text, page, ...): one row a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plectrum.functions.fidelity import critical_tokens, fidelity
from plectrum.functions.rules import RULES, apply_rules, fenced
from plectrum.functions.text import SPACE, normalized, trim, units

#: Block types that a parser has already classified as page furniture (fixed values).
LAYOUT_NOISE = ("page-header", "page-footer", "page-number")
ENGINE_VERSION = "1.1.0"
TRANSFORMATIONS = "array<struct<rule:string,source:string,replacement:string>>"
PAGE_NUMBER = rf"(?iu)^(?:p[aá]g\.?[{SPACE}]*)?\d{{1,4}}(?:[{SPACE}]*(?:de|/|-|d[eé])[{SPACE}]*\d{{1,4}})?$"


def is_page_number(text: Column) -> Column:
    return trim(text).rlike(PAGE_NUMBER)


def repeated_chrome(blocks: DataFrame) -> DataFrame:
    """blocks plus ``chrome``: short texts that stand on a quarter of the pages, three at least.

    Only the first block of a text on a page is marked, headings and list items never.  All windows
    share the document key, so one exchange serves them.
    """
    short = (F.length("text") <= 120) & (units(F.col("text")) <= 120)  # the keys of long texts are never made
    fit = ~F.col("type").isin("page-header", "page-footer") & short
    step = blocks.withColumn("_key", F.when(fit, F.nullif(normalized(F.col("text")), F.lit(""))))
    doc, same = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "_key")
    step = step.withColumn("_pages", F.size(F.collect_set("page").over(doc)))
    step = step.withColumn("_first", F.row_number().over(Window.partitionBy("doc_id", "_key", "page").orderBy("ord")) == 1)
    step = step.withColumn("_on", F.sum(F.col("_first").cast("int")).over(same))
    enough = F.col("_on") >= F.greatest(F.lit(3), F.ceil(F.col("_pages") * 0.25))
    chrome = F.col("_key").isNotNull() & F.col("_first") & enough & ~F.col("type").isin("heading", "list-item")
    return step.withColumn("chrome", F.coalesce(chrome, F.lit(False))).drop("_key", "_pages", "_first", "_on")


def _segment_ids(df: DataFrame) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return df.withColumn("segment_id", F.concat(F.lit("s"), at.cast("string")))


def literal_plan(blocks: DataFrame) -> DataFrame:
    """Every block as it is, page furniture included."""
    return _segment_ids(blocks).select(
        "doc_id", "segment_id", "ord", "type", "page", F.col("text").alias("source_text"), F.col("text").alias("spoken_text"),
        F.array().cast(TRANSFORMATIONS).alias("transformations"), F.lit(True).alias("fidelity_ok"), F.lit(False).alias("fallback"),
        F.lit(False).alias("muted"), F.lit(None).cast("string").alias("muted_by"),
    )


def listen_plan(blocks: DataFrame, detect_chrome: bool = True, rules=RULES, only: Column | None = None) -> DataFrame:
    """Rewritten segments; one that loses or invents a critical literal falls back to its source.

    ``only``: the blocks whose segments are wanted.  All are numbered and looked at for furniture; the rules run on these alone,
    since a filter of the plan is not carried below its fences.
    """
    marked = repeated_chrome(blocks) if detect_chrome else blocks.withColumn("chrome", F.lit(False))
    typed = F.col("type").isin(*LAYOUT_NOISE)
    step = _segment_ids(marked).withColumn("_noise", typed | F.col("chrome"))
    if only is not None:
        step = step.where(only)
    # muted blocks pass the rules as empty text
    step = apply_rules(step.withColumn("_in", F.when(~F.col("_noise"), F.col("text"))), "_in", rules)
    pausing = (F.col("type") == "heading") & (F.col("spoken") != "")
    pause = F.array(F.struct(F.lit("pause").alias("rule"), F.lit("").alias("source"), F.lit(", ").alias("replacement")))
    step = step.withColumns(
        {
            "spoken": F.when(pausing, F.concat(F.regexp_replace("spoken", "[:.]+$", ""), F.lit(","))).otherwise(F.col("spoken")),
            "records": F.when(pausing, F.concat("records", pause)).otherwise(F.col("records")),
        }
    )
    changed = F.col("spoken") != F.coalesce(F.col("_in"), F.lit(""))
    # an unchanged text keeps its literals
    step = step.withColumn("_ok", F.when(changed, fidelity(F.coalesce("_in", F.lit("")), F.col("spoken"), F.col("records"))["ok"]).otherwise(F.lit(True)))
    mute = F.array(F.struct(F.lit("layout-noise").alias("rule"), F.col("text").alias("source"), F.lit("").alias("replacement")))
    out = step.select(
        "doc_id", "segment_id", "ord", "type", "page", F.col("text").alias("source_text"),
        F.when(F.col("_noise"), F.lit("")).when(~F.col("_ok"), F.col("text")).otherwise(F.col("spoken")).alias("spoken_text"),
        F.when(F.col("_noise"), mute).otherwise(F.col("records")).alias("transformations"),
        F.col("_ok").alias("fidelity_ok"), (~F.col("_ok")).alias("fallback"), F.col("_noise").alias("muted"),
        F.when(typed, F.lit("layout-classification")).when(F.col("_noise"), F.lit("repeat-detector")).alias("muted_by"),
    )
    return fenced(out)


def gold_plan(gold: DataFrame, blocks: DataFrame) -> DataFrame:
    """Manual texts on their blocks, in gold order; entries without a block drop out before numbering."""
    hit = gold.join(blocks.select("doc_id", "block_id", F.col("text").alias("source_text"), "page"), ["doc_id", "block_id"])
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("entry")) - 1
    return hit.withColumn("segment_id", F.concat(F.lit("g"), at.cast("string")))


def plan_stats(segments: DataFrame) -> DataFrame:
    """Counters of a listen plan and its histogram of rules over accepted segments."""
    heard, kept = ~F.col("muted"), ~F.col("muted") & ~F.col("fallback")
    hits = F.flatten(F.collect_list(F.when(kept, F.transform("transformations", lambda t: t["rule"]))))
    stats = segments.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks_total"), F.count_if(heard).alias("segments"), F.count_if(F.col("muted")).alias("muted_noise"),
        F.count_if(kept & (F.size("transformations") > 0)).alias("transformed"), F.count_if(kept & (F.size("transformations") == 0)).alias("unchanged"),
        F.count_if(F.col("fallback")).alias("rejected"), hits.alias("_hits"),
    )
    names = F.array_sort(F.array_distinct("_hits"))
    counts = F.transform(names, lambda n: F.size(F.filter("_hits", lambda h: h == n)))
    return stats.withColumn("rule_hits", F.map_from_arrays(names, counts)).drop("_hits")


# Running texts that may be left out when they repeat.
KNOWN_CHROME = ("boletín oficial del estado", "encabezado repetido", "pie de página", "documento oficial")


def omission_is_safe(blocks: DataFrame) -> DataFrame:
    """blocks plus ``omit``: page numbers, rules of separators, and known running texts on three pages."""
    key = normalized(F.col("text"))
    same = Window.partitionBy("doc_id", "type", "_key")
    step = blocks.withColumn("_key", key)
    pages = F.size(F.collect_set("page").over(same))
    known = F.col("type").isin("page-header", "page-footer") & F.col("_key").isin(*KNOWN_CHROME) & (pages >= 3)
    plain = F.size(critical_tokens(F.coalesce("text", F.lit("")))) == 0
    number = (F.col("type") == "page-number") & is_page_number(F.col("text"))
    glyphs = F.col("text").rlike(f"^[{SPACE}—–_*=·•-]+$")
    return step.withColumn("omit", F.coalesce(number | glyphs | (plain & known), F.lit(False))).drop("_key")


def product_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks as the product reads them: tables as one paragraph, notes after their references.

    blocks has ``level`` (the column of a table cell, null for the first).
    """
    from plectrum.operators.tables import speak_tables

    marked = omission_is_safe(blocks)
    notes = marked.where(F.col("type") == "footnote").withColumn("_n", F.regexp_extract("text", r"^(\d+)", 1)).where("_n <> ''")
    notes = notes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "_n", "text"))).alias("_notes"))
    body = marked.where(~F.col("type").isin("footnote", "table-cell")).join(notes, "doc_id", "left")
    refs = F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), 1)

    def note(ref: Column) -> Column:
        own = F.try_element_at(F.filter("_notes", lambda n: n["_n"] == ref), F.lit(-1))  # the last one wins; a reference may have none
        return F.coalesce(F.concat(F.lit(" Nota "), ref, F.lit(": "), own["text"]), F.lit(""))

    typed = F.col("type").isin(*LAYOUT_NOISE)
    with_notes = F.when(F.col("_notes").isNull() | typed | F.col("omit"), F.col("text")).otherwise(
        F.concat("text", F.coalesce(F.array_join(F.transform(refs, note), ""), F.lit("")))
    )
    body = body.select(
        "doc_id", "ord", F.when(F.col("omit"), F.lit("page-footer")).when(typed, F.lit("paragraph")).otherwise(F.col("type")).alias("type"),
        with_notes.alias("text"), "page",
    )
    # a run of empty cells alone is no table: its cells stay
    cells, empty = speak_tables(marked.where("type = 'table-cell'"), marked)
    return body.unionByName(cells).unionByName(empty)


def product_plan(blocks: DataFrame) -> DataFrame:
    return listen_plan(product_blocks(blocks), detect_chrome=False)
