"""Contents, chapters and playback lookups between blocks, segments, chunks, words and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plectrum.functions.text import units
from plectrum.operators.lookup import first_holding

#: UTF-16 units of a heading that must stand in a chunk, and of a label in a block.
HEADING_UNITS, LABEL_UNITS = 60, 30


def contents(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, label, depth, block_index: one entry a heading, closing marks of the label dropped."""
    heads = blocks.where(F.col("type") == "heading")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    label = F.regexp_replace("text", "[:.]+$", "")
    return heads.select("doc_id", at.cast("long").alias("pos"), label.alias("label"), F.least(F.coalesce("level", F.lit(1)) - 1, F.lit(3)).cast("int").alias("depth"), F.col("ord").cast("long").alias("block_index"))


def chunk_of_segment(chunks: DataFrame) -> DataFrame:
    """doc_id, segment_id, chunk: the first chunk that holds each segment."""
    return chunks.select("doc_id", "chunk", F.explode("segment_ids").alias("segment_id")).groupBy("doc_id", "segment_id").agg(F.min("chunk").alias("chunk"))


def chunk_of_entry(toc: DataFrame, blocks: DataFrame, segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, pos, chunk: where playing starts for each contents entry; entries without a chunk drop out.

    segments: doc_id, ord (of their block), segment_id.
    """
    block = toc.join(blocks.select("doc_id", F.col("ord").cast("long").alias("block_index")), ["doc_id", "block_index"])
    first = segments.groupBy("doc_id", F.col("ord").cast("long").alias("block_index")).agg(F.min_by("segment_id", "ord").alias("segment_id"))
    return block.join(first, ["doc_id", "block_index"]).join(chunk_of_segment(chunks), ["doc_id", "segment_id"]).select("doc_id", "pos", "chunk")


def active_entry(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """For each block (doc_id, ord) the label of the last list entry whose block_index is not after it, or null.

    The last in the list, not the nearest: entries are merged with the blocks in block order and the largest
    position so far is carried, one sort a document instead of a range join.
    """
    marks = toc.select("doc_id", F.col("block_index").cast("long").alias("at"), F.struct(F.col("pos").cast("long").alias("pos"), F.col("label").cast("string").alias("label")).alias("entry"), F.lit(False).alias("ask"))
    asks = blocks.select("doc_id", F.col("ord").cast("long").alias("at"), F.lit(None).cast("struct<pos:bigint,label:string>").alias("entry"), F.lit(True).alias("ask"))
    w = Window.partitionBy("doc_id").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asks).withColumn("last", F.max("entry").over(w)).where("ask").select("doc_id", F.col("at").alias("ord"), F.col("last.label").alias("label"))


def clean_target(href: Column) -> Column:
    """The section path of a link: fragment off, percent escapes decoded; addresses inside a book have none."""
    raw = F.split_part(href, F.lit("#"), F.lit(1))
    return F.when(~href.rlike(r"(?i)^epubcfi\("), F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))


def entry_blocks(toc: DataFrame, sections: DataFrame) -> DataFrame:
    """toc (doc_id, pos, label, href) with block_index: the first block of its section, 0 if there is none.

    sections: doc_id, path, block_index.
    """
    first = sections.groupBy("doc_id", "path").agg(F.min("block_index").alias("block_index"))
    hit = toc.withColumn("path", clean_target(F.col("href"))).join(first, ["doc_id", "path"], "left")
    return hit.select("doc_id", "pos", "label", F.coalesce("block_index", F.lit(0)).cast("long").alias("block_index"))


def head_units(text: Column, n: int) -> Column:
    """The first n UTF-16 units; a pair that would be cut in two is left out."""
    raw = F.encode(text, "UTF-16BE")
    half = F.hex(F.substring(raw, 2 * n - 1, 1)).between("D8", "DB")
    cut = F.substring(raw, F.lit(1), F.when(half, 2 * n - 2).otherwise(2 * n))
    return F.when(units(text) <= n, text).otherwise(F.decode(cut, "UTF-16BE"))


def labelled_headings(toc: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks with type ``heading`` and level 1 where a contents label begins: the first block that has its first 30 units."""
    needles = toc.select("doc_id", F.col("pos").alias("key"), head_units(F.lower("label"), LABEL_UNITS).alias("needle"))
    texts = blocks.select("doc_id", F.col("ord").alias("place"), F.lower("text").alias("text"))
    first = first_holding(needles, texts).select("doc_id", F.col("place").alias("ord")).distinct().withColumn("_head", F.lit(True))
    out = blocks.join(first, ["doc_id", "ord"], "left")
    return out.withColumns({"type": F.when(F.col("_head"), "heading").otherwise(F.col("type")), "level": F.when(F.col("_head"), 1).otherwise(F.col("level"))}).drop("_head")


def heading_chunks(headings: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, ord, title, chunk: the first chunk whose text has the heading's first 60 units, whatever the case.

    headings: doc_id, ord, text; those found nowhere drop out.
    """
    title = F.trim(F.regexp_replace("text", "[:.]+$", ""))
    needle = F.lower(head_units(F.col("text"), HEADING_UNITS))
    heads = headings.select("doc_id", "ord", title.alias("title"), needle.alias("needle")).where("title <> ''")
    texts = chunks.select("doc_id", F.col("chunk").alias("place"), F.lower("text").alias("text"))
    found = first_holding(heads.select("doc_id", F.col("ord").alias("key"), "needle"), texts)
    return heads.join(found.select("doc_id", F.col("key").alias("ord"), F.col("place").alias("chunk")), ["doc_id", "ord"]).select("doc_id", "ord", "title", "chunk")


def chapters(placed: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, start, title: headings by chunk, one that repeats its predecessor's chunk out, and the document's own
    title first where no chapter starts at the first chunk.

    placed: doc_id, ord, title, chunk; documents: doc_id, name.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = F.lag("chunk").over(w)
    own = placed.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("chunk")))
    first = own.groupBy("doc_id").agg(F.min_by("chunk", "ord").alias("first"))
    bare = documents.join(first, "doc_id", "left").where(F.coalesce("first", F.lit(1)) > 0)
    lead = bare.select("doc_id", F.lit(-1).cast("long").alias("ord"), F.regexp_replace("name", r"\.[^.]+$", "").alias("title"), F.lit(0).cast("long").alias("chunk"))
    return lead.unionByName(own.select("doc_id", F.col("ord").cast("long").alias("ord"), "title", F.col("chunk").cast("long").alias("chunk"))).withColumnRenamed("chunk", "start")


def page_dividers(segments: DataFrame) -> DataFrame:
    """segments plus shows_page: whether the page differs from the segment's before; the first is compared with 0."""
    before = F.lag("page", 1, 0).over(Window.partitionBy("doc_id").orderBy("ord"))
    return segments.withColumn("shows_page", F.coalesce("page", F.lit(0)) != F.coalesce(before, F.lit(0)))


def prefetch(chunks: DataFrame, depth: int = 2) -> DataFrame:
    """chunks plus wanted: the chunks to have ready while one plays, itself included."""
    w = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(0, depth)
    return chunks.withColumn("wanted", F.collect_list("chunk").over(w))


def newest(entries: DataFrame, by: str, order: Column, most: int = 100) -> DataFrame:
    """The last ``most`` entries of each log."""
    return entries.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order.desc()))).where(F.col("_r") <= most).drop("_r")


def words_at(points: DataFrame, words: DataFrame) -> DataFrame:
    """points (by, local_ms, ...) plus active_word (null between words) and n_started.

    words: by, words, an array of (off_ms, dur_ms, word) in order, as many as a chunk has.  Of words that overlap the first counts.
    """
    hit = points.join(words, "by", "left")
    started = F.filter("words", lambda w: w["off_ms"] <= F.col("local_ms"))
    active = F.get(F.filter(started, lambda w: F.col("local_ms") < w["off_ms"] + w["dur_ms"]), F.lit(0))
    return hit.select(*points.columns, active["word"].alias("active_word"), F.coalesce(F.size(started), F.lit(0)).alias("n_started"))


def estimated_seconds(known: Column, n_known: Column, total: Column) -> Column:
    """The known time plus an average for each chunk whose duration is not known yet."""
    average = F.when(n_known > 0, known / n_known).otherwise(F.lit(0.0))
    return known + F.greatest(F.lit(0), total - n_known) * average


def prepared_share(ready: Column, total: Column) -> Column:
    """Whole percent of the chunks that are ready."""
    return F.when(total > 0, F.floor(ready / total * 100 + 0.5)).otherwise(F.lit(0)).cast("int")


def provenance(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, block_ids, pages, box, source_start, source_end of each block's segment."""
    return blocks.select(
        "doc_id", "ord", F.array(F.concat(F.lit("b"), F.col("ord").cast("string"))).alias("block_ids"), F.array("page").alias("pages"),
        F.col("box") if "box" in blocks.columns else F.lit(None).cast("array<double>").alias("box"), F.lit(0).alias("source_start"), units(F.col("text")).alias("source_end"),
    )


def merged_provenance(blocks: DataFrame, *by: str) -> DataFrame:
    """One provenance a group of blocks: ids in order, distinct pages ascending, the union of the boxes, all units."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("ord"))), lambda x: F.concat(F.lit("b"), x["ord"].cast("string")))
    corner = lambda f, i: f(F.get("box", F.lit(i)))
    box = F.when(F.count("box") > 0, F.array(corner(F.min, 0), corner(F.min, 1), corner(F.max, 2), corner(F.max, 3)))
    return blocks.groupBy(*by).agg(
        own.alias("block_ids"), F.array_sort(F.collect_set("page")).alias("pages"), box.alias("box"), F.lit(0).alias("source_start"),
        F.sum(units(F.col("text"))).cast("int").alias("source_end"),
    )
