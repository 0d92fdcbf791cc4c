"""Line deduplication by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; a line above the ratio
(and on enough pages) is boilerplate there and dropped from that host's pages.  Lines travel as
128-bit hashes, counted once a page and pre-aggregated before the shuffle, so a hot host costs its
distinct lines.  A host has at most (lines a page) / ratio boilerplate lines; they meet the pages as
one list a host, broadcast if their measured size is small, else by a join that AQE splits by skew.

By default every row is a page, as in the SQL of op7.  With ``page`` rows of a host that agree in it count as one
page, in the line counts and in the host's pages, so a text is not boilerplate for being copied often.  The
pipeline gives the group of near copies of each row, since the stage that drops them comes after.

Edge cases: a null host is a host of its own; a null text stays null and counts as a page; blank lines are
kept and never counted; a line repeated in one page counts once there; repeated rows are
pages of their own; a page can become empty but no row goes; an empty table stays empty; all columns
of the input, whatever their names, are returned as they were but the text; the two added columns, the last,
are named _n_lines and _n_dropped, with further underscores in front where the input has such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plectrum.llm.common import SPACE_CLASS, documents, free_names, quoted, scratch, written

RATIO, MIN_PAGES = 0.05, 5
BROADCAST_BYTES = 16 << 20


def _first(line: Column) -> Column:
    return F.xxhash64(line)


def _second(line: Column) -> Column:
    return F.xxhash64(F.lit("second"), line)


def _hash(line: Column) -> Column:
    return F.struct(_first(line).alias("a"), _second(line).alias("b"))


def _real(line: Column) -> Column:
    return line.rlike(f"[^{SPACE_CLASS[1:]}")


def boilerplate(df: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, text: str = "text", page: Column | None = None) -> DataFrame:
    """host, line hash (a, b), pages with the line, pages of the host; lines above the ratio only."""
    told = [] if page is None else [page.alias("_page")]
    pages = df.select(F.coalesce(host, F.lit("\0")).alias("_host"), F.col(*quoted([text])).alias("_text"), *told)
    lines = F.array_distinct(F.filter(F.split("_text", "\n"), _real))
    own = [] if page is None else ["_page"]
    counted = pages.select("_host", *own, F.explode(F.transform(lines, _hash)).alias("_h"))
    if own:
        counted, pages = counted.distinct(), pages.select("_host", "_page").distinct()
    counted = counted.groupBy("_host", "_h.a", "_h.b").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("host_pages"))
    return counted.join(totals, "_host").where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))


def drop_boilerplate(df: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, text: str = "text", page: Column | None = None) -> DataFrame:
    """df with its texts less their host's boilerplate lines, plus _n_lines and _n_dropped."""
    found = written(boilerplate(df, host, ratio, min_pages, text, page), scratch(df.sparkSession, "boilerplate"))
    lists = found.groupBy("_host").agg(F.collect_list("a").alias("_a"), F.collect_list("b").alias("_b"))
    size = found.count() * 16 + found.select("_host").distinct().count() * 64
    if size <= BROADCAST_BYTES:
        lists = F.broadcast(lists)
    # the rest of a row travels in one column, so that its names cannot clash with the helpers'
    rest = [c for c in df.columns if c != text]
    row = F.struct(F.lit(0).alias("\0"), *[F.col(q).alias(c) for q, c in zip(quoted(rest), rest, strict=True)])
    keyed = df.select(row.alias("_row"), F.coalesce(host, F.lit("\0")).alias("_host"), F.col(*quoted([text])).alias("_text")).join(lists, "_host", "left")
    # a page's own lines are met with its host's list by a hash set; what is left is its own few hits
    split = keyed.select("_row", "_text", "_a", "_b", F.when(F.col("_a").isNotNull(), F.split("_text", "\n")).alias("_lines"))
    hits = [F.array_intersect(F.transform("_lines", half), F.col(name)).alias(name) for half, name in ((_first, "_a"), (_second, "_b"))]
    near = split.select("_row", "_text", "_lines", *hits)
    kept = F.filter("_lines", lambda x: ~(F.array_contains("_a", _first(x)) & F.array_contains("_b", _second(x)) & _real(x)))
    # used twice below, so it stays a projection of its own and each text is split once
    cut = near.select("_row", "_text", F.when(F.size("_a") > 0, kept).otherwise(F.col("_lines")).alias("_kept"))
    names = free_names(df.columns, "_n_lines", "_n_dropped")
    n_lines = F.coalesce(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return cut.select(
        *[F.coalesce(F.array_join("_kept", "\n"), "_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in df.columns],
        n_lines.alias(names[0]),
        F.when(F.col("_kept").isNull(), 0).otherwise(n_lines - F.size("_kept")).cast("long").alias(names[1]),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = drop_boilerplate(docs, F.col("source"))
    return out.select("doc_id", "source", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))
