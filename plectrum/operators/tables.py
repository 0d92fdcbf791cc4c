"""Table speech: runs of cells become one sentence-like paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plectrum.functions.text import trim


def cell_runs(blocks: DataFrame) -> DataFrame:
    """The table cells of blocks with ``run``, alike for cells with nothing between them."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    is_cell = F.col("type") == "table-cell"
    run = F.sum((~is_cell).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("run", run).where(is_cell)


def _row_speech(header: Column, row: Column) -> Column:
    pairs = F.zip_with(F.slice(header, F.lit(1), F.size(row)), F.slice(row, F.lit(1), F.size(header)), lambda h, c: F.concat(h, F.lit(": "), c))
    return F.array_join(pairs, ". ")


def speak(cells: Column, columns: Column) -> Column:
    """cells: texts in order, columns: how many a row; the first row is the header."""
    rows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(cells) / columns).cast("int") - 1)), lambda r: F.slice(cells, r * columns + 1, columns))
    header = F.slice(cells, F.lit(1), columns)
    spoken = F.transform(
        rows,
        lambda row, i: F.concat(F.when(columns > 2, F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(". "))).otherwise(F.lit("")), _row_speech(header, row)),
    )
    return F.when(F.size(cells) <= columns, F.lit("")).otherwise(F.array_join(spoken, ". "))


def speak_tables(cells: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables as paragraphs, cells of runs that hold no text); header-only tables say nothing."""
    runs = cell_runs(blocks)
    level = F.coalesce(F.col("level"), F.lit(0)) if "level" in blocks.columns else F.lit(0)
    text = trim(F.coalesce("text", F.lit("")))
    whole = runs.groupBy("doc_id", "run").agg(
        F.min("ord").alias("ord"),
        F.min_by("page", "ord").alias("page"),
        F.sort_array(F.collect_list(F.when(text != "", F.struct("ord", level.alias("level"), text.alias("text"))))).alias("c"),
    )
    columns = F.array_max(F.transform("c", lambda x: x["level"])) + 1
    # within a row, cells stand by column
    placed = F.transform("c", lambda x, i: F.struct(F.floor(i / F.col("columns")).alias("row"), x["level"].alias("level"), i.alias("i"), x["text"].alias("text")))
    full = whole.where(F.size("c") > 0).withColumn("columns", columns)
    texts = F.transform(F.sort_array(placed), lambda x: x["text"])
    said = full.withColumn("text", speak(texts, F.col("columns"))).where("text <> ''")
    tables = said.select("doc_id", "ord", F.lit("paragraph").alias("type"), "text", "page")
    hollow = whole.where(F.size("c") == 0).select("doc_id", "run")
    left = runs.join(hollow, ["doc_id", "run"], "left_semi").select("doc_id", "ord", "type", "text", "page")
    return tables, left
