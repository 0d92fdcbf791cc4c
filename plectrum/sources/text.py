"""Plain text: decoding by byte order mark, and blocks between blank lines."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plectrum.functions.text import trim


def _western(raw: pd.Series) -> pd.Series:
    import codecs

    # the five unassigned bytes are the controls of the same number
    codecs.register_error("same-number", lambda e: (chr(e.object[e.start]), e.start + 1))
    return raw.map(lambda b: b.decode("cp1252", "same-number"))


def decoded(content: Column) -> Column:
    """Text of binary content: a UTF-16 or UTF-8 mark decides, else UTF-8 if valid, else Windows-1252."""
    western = F.pandas_udf(_western, "string")
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n, 2_000_000_000)
    return (
        F.when(head.startswith("FFFE"), F.decode(rest(3), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(rest(3), "UTF-16BE"))
        .when(head == "EFBBBF", F.decode(rest(4), "UTF-8"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(western(content))
    )


def text_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, ord, text, source_ref: trimmed lines between blank ones, joined by spaces.

    Blank lines number the runs of the others, within each document's own array: nothing is shuffled.
    """
    lines = docs.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), trim).alias("l"))
    # starts of runs: a line with text after none
    starts = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: (F.get("l", i) != "") & ((i == 0) | (F.get("l", i - 1) == "")))
    ends = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: (F.get("l", i) != "") & ((i == F.size("l") - 1) | (F.get("l", i + 1) == "")))
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    found = lines.select("doc_id", "l", F.posexplode(spans).alias("ord", "s"))
    text = F.array_join(F.slice("l", F.col("s.a") + 1, F.col("s.b") - F.col("s.a") + 1), " ")
    ref = F.concat(F.lit("L"), (F.col("s.a") + 1).cast("string"), F.lit("-L"), (F.col("s.b") + 1).cast("string"))
    return found.select("doc_id", "ord", F.lit("paragraph").alias("type"), text.alias("text"), F.lit(1).alias("page"), ref.alias("source_ref"))


def line_blocks(docs: DataFrame) -> DataFrame:
    """Every line as a block: the text's own line breaks are its layout."""
    return docs.select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
