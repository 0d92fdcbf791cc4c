"""Page layout: positioned text items to lines and typed blocks.

Items (doc_id, page, page_width, page_height, seq, str, x, y_top, width, height) are what a page reader
gives; lengths are in points from the top left.  Grouping items into lines compares each with
the first item of the line, so sorted partitions are read through once, page after page; all else is native.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plectrum.functions.text import SPACE, blank, rounded, trim

# Beginnings of list items, and page numbers in the footer.
LIST_START = rf"(?i)^(?:-|[•·◦▪‣]|\(?[a-z]\)|\(?[ivxlcdm]{{1,7}}\)|\(?\d{{1,3}}[).])[{SPACE}]"
FOOTER_NUMBER = rf"(?iu)^[{SPACE}]*(?:p[aá]g(?:ina)?\.?[{SPACE}]*)?\d{{1,4}}(?:[{SPACE}]*(?:de|/|-)[{SPACE}]*\d{{1,4}})?[{SPACE}]*\z"
#: The body height of a document without lines.
DEFAULT_HEIGHT = 10.0


def lines(items: DataFrame) -> DataFrame:
    """doc_id, page, page_height, line, x, y, width, height, text of the items that hold text.

    An item belongs to a line if it lies within half its height, 2 at least, of the line's first item.
    A gap of more than .45 of the height before it becomes a blank.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, anchor, at = None, 0.0, 0
        for batch in batches:
            doc_, page_, y_, height_ = (batch.column(c).to_pylist() for c in ("doc_id", "page", "y_top", "height"))
            out = []
            for key, y, height in zip(zip(doc_, page_, strict=True), y_, height_, strict=True):
                if key != page:
                    page, anchor, at = key, y, 0
                elif abs(y - anchor) > max(height * 0.5, 2):
                    anchor, at = y, at + 1
                out.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "line"])

    told = items.where(~blank(F.col("str"))).select("doc_id", "page", "page_height", "seq", "str", "x", "y_top", "width", "height")
    ordered = told.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "y_top", "x", "seq")
    numbered = ordered.mapInArrow(number, StructType([*told.schema.fields, *StructType.fromDDL("line long").fields]))
    # the order of the sort above decides between equal places
    run = F.sort_array(F.collect_list(F.struct("x", "y_top", "seq", "width", "height", "str")))
    own = numbered.groupBy("doc_id", "page", "line").agg(F.first("page_height").alias("page_height"), F.min("y_top").alias("y"), run.alias("r"))
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"), F.lit(0.0).alias("height"))

    def add(state: Column, item: Column) -> Column:
        wide = state["end"].isNotNull() & (item["x"] - state["end"] > state["height"] * 0.45)
        text = F.concat(state["text"], F.when(wide, " ").otherwise(""), item["str"])
        return F.struct(text.alias("text"), (item["x"] + item["width"]).alias("end"), item["height"].alias("height"))

    heights = F.filter(F.transform("r", lambda i: i["height"]), lambda h: h > 0)
    right = F.array_max(F.transform("r", lambda i: i["x"] + i["width"]))
    x = F.get("r", F.lit(0))["x"]
    out = own.select(
        "doc_id", "page", "page_height", "line", x.alias("x"), "y", (right - x).alias("width"), F.coalesce(F.array_max(heights), F.lit(8.0)).alias("height"),
        F.aggregate("r", start, add, lambda s: s["text"]).alias("text"),
    )
    order = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y", "x", "line")) - 1
    return out.withColumn("line", order.cast("long"))


def body_height(lines_: DataFrame) -> DataFrame:
    """doc_id, body: the most frequent line height to half a point, of equals the one seen first."""
    half = rounded(F.col("height") * 2, 0) / 2
    counted = lines_.groupBy("doc_id", half.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "line")).alias("first"))
    best = F.min_by("h", F.struct((-F.col("n")).alias("n"), "first"))
    return counted.groupBy("doc_id").agg(best.alias("body"))


def band(y: Column, height: Column, page_height: Column, body: Column) -> Column:
    """header or footer for small print in the outer tenths of a page, else body."""
    small = height <= body * 0.95
    return F.when(small & (y + height < page_height * 0.1), "header").when(small & (y > page_height * 0.9), "footer").otherwise("body")


def blocks(items: DataFrame) -> DataFrame:
    """doc_id, ord, type, text, page, level, box of the blocks of positioned items, in reading order.

    A block ends at a gap, a jump to the side, another size, another band, or where a list begins or ends.
    """
    each = lines(items)
    each = each.join(body_height(each), "doc_id", "left").withColumn("body", F.coalesce("body", F.lit(DEFAULT_HEIGHT)))
    each = each.withColumns({"band": band(F.col("y"), F.col("height"), F.col("page_height"), F.col("body")), "listed": trim(F.col("text")).rlike(LIST_START)})
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    was = lambda c: F.lag(c).over(w)
    new = (
        was("y").isNull()
        | (F.col("y") - (was("y") + was("height")) > F.greatest(was("height") * 0.6, F.lit(5.0)))
        | (F.abs(F.col("x") - was("x")) > was("height") * 4)
        | (F.col("height") > was("height") * 1.15)
        | (was("height") > F.col("height") * 1.15)
        | (F.col("listed") != was("listed"))
        | (F.col("band") != was("band"))
    )
    split = each.withColumn("new", new).withColumn("b", F.sum(F.col("new").cast("int")).over(w))
    said = F.sort_array(F.collect_list(F.struct("line", trim(F.col("text")).alias("text"))))
    text = F.array_join(F.filter(F.transform(said, lambda s: s["text"]), lambda t: t != ""), " ")
    group = split.groupBy("doc_id", "page", "b").agg(
        text.alias("text"), F.min_by("band", "line").alias("band"), F.count(F.lit(1)).alias("n"), F.max("height").alias("high"), F.first("body").alias("body"), F.every("listed").alias("listed"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"),
    )
    heading = (F.col("band") == "body") & (F.col("n") <= 2) & (F.col("high") > F.col("body") * 1.15)
    kind = (
        F.when(F.col("band") == "header", "page-header")
        .when(F.col("band") == "footer", F.when(F.col("text").rlike(FOOTER_NUMBER), "page-number").otherwise("page-footer"))
        .when(F.col("listed"), "list-item")
        .when(heading, "heading")
        .when(F.col("high") < F.col("body") * 0.8, "footnote")
        .otherwise("paragraph")
    )
    typed = group.where("text <> ''").withColumn("type", kind)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "b")) - 1
    level = F.when(F.col("type") == "heading", F.when(F.col("high") > F.col("body") * 1.45, 1).otherwise(2))
    box = F.array(*[rounded(F.col(c), 1) for c in ("x0", "y0", "x1", "y1")])
    return typed.select("doc_id", order.alias("ord"), "type", "text", F.col("page").cast("int").alias("page"), level.alias("level"), box.alias("box"))
