"""Pairs of texts by Sørensen–Dice over word multisets, without meeting on frequent words.

A text is the set of its words numbered by occurrence, so the multiset overlap is a set overlap.  Two texts of n and m
words reach a similarity t only with an overlap of at least t(n + m)/2, hence they share one of the first few words of
either in any common order; rare words come first, so a frequent word is met only in a text that has hardly another.
Where in their orders two texts meet bounds the overlap that is left, which rules out most pairs that do meet.  What
remains is compared in full.

The order comes from counts by hash bucket, a table of bounded size; collisions change the order for all texts alike,
and so the speed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plectrum.functions.spanish import let
from plectrum.functions.text import WORD, word_tokens
from plectrum.session import fresh_folder

#: Buckets that words are counted in: a broadcast of some megabytes at most.
BUCKETS = 1 << 17
_EPS = 1e-9


def numbered_words(text: Column) -> Column:
    """The words of a text, each with the number of its occurrence behind a control character; none for null."""

    def runs(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))

        def each(s: Column) -> Column:
            def run(a: Column, j: Column) -> Column:
                end = F.coalesce(F.get(s, j + 1), F.size(words))
                return F.transform(F.sequence(F.lit(1), end - a), lambda k: F.concat(F.get(words, a), F.lit("\x01"), k.cast("string")))

            return F.flatten(F.transform(s, run))

        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(let(starts, each))

    return let(F.array_sort(word_tokens(F.coalesce(text, F.lit("")))), runs)


def _least_overlap(least: float, total: Column) -> Column:
    return F.ceil(F.lit(least / 2) * total - _EPS)


def _prefixes(records: DataFrame, sketch: DataFrame, least: float, by: list[str], name: str) -> DataFrame:
    """by, id, size, word hash and place of the first words of each text in the common order."""
    words = records.select(*by, F.col("id").alias(name), F.size("words").alias(f"n_{name}"), F.explode("words").alias("w"))
    words = words.select(*by, name, f"n_{name}", F.xxhash64(*by, "w").alias("h")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    placed = words.join(F.broadcast(sketch), "bucket")
    place = F.row_number().over(Window.partitionBy(*by, name).orderBy("often", "h")) - 1
    smallest = F.ceil(F.col(f"n_{name}") * F.lit(least / (2 - least)) - _EPS)
    most = F.col(f"n_{name}") - _least_overlap(least, F.col(f"n_{name}") + smallest) + 1
    return placed.withColumn(f"i_{name}", place).where(F.col(f"i_{name}") < most).select(*by, name, f"n_{name}", f"i_{name}", "h")


def meetings(left: DataFrame, right: DataFrame, least: float, by: list[str] | None = None) -> DataFrame:
    """by, left_id, right_id once for each word on which two texts meet that may still be similar enough; left, right as from :func:`records`."""
    by = by or []
    exploded = lambda df: df.select(*by, F.explode("words").alias("w")).select(F.pmod(F.xxhash64(*by, "w"), F.lit(BUCKETS)).alias("bucket"))
    sketch = exploded(left).unionByName(exploded(right)).groupBy("bucket").agg(F.count(F.lit(1)).alias("often"))
    a, b = _prefixes(left, sketch, least, by, "left_id"), _prefixes(right, sketch, least, by, "right_id")
    n, m = F.col("n_left_id"), F.col("n_right_id")
    left_over = F.least(n - F.col("i_left_id"), m - F.col("i_right_id"))
    return a.join(b, [*by, "h"]).where(left_over >= _least_overlap(least, n + m)).select(*by, "left_id", "right_id")


def records(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, id, words of a table by, id, text; texts without a word are not similar to any here."""
    return df.select(*(by or []), "id", numbered_words(F.col("text")).alias("words")).where(F.size("words") > 0)


def _sizes(df: DataFrame) -> DataFrame:
    return df.select(F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD)).alias("n")).where("n > 0")


def _ends(sizes: DataFrame) -> tuple[int, int]:
    low, high = sizes.agg(F.min("n"), F.max("n")).first()
    return (low, high) if high else (1, 0)


def _kept(df: DataFrame, by: list[str], low: int, high: int, least: float) -> DataFrame:
    """The records of texts whose size is within reach of the sizes from low to high, as a table: words are cut once."""
    ratio = least / (2 - least)
    n = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD))
    near = df.where((n > 0) & (n >= F.lit(low * ratio - 1)) & (n * F.lit(ratio) <= F.lit(high + 1)))
    folder = fresh_folder(df.sparkSession, "word-records")
    made = records(near, by)
    made.write.parquet(folder)
    return df.sparkSession.read.schema(made.schema).parquet(folder)


def similar_pairs(left: DataFrame, right: DataFrame, least: float, by: list[str] | None = None) -> DataFrame:
    """by, left_id, right_id, dice of the pairs at or above least (above 0), from tables by, id, text with one row an id; pairs agree in ``by``."""
    by = by or []
    a = _kept(left, by, *_ends(_sizes(right)), least)
    b = _kept(right, by, *_ends(a.select(F.size("words").alias("n"))), least)
    pairs = meetings(a, b, least, by).distinct()
    full = pairs.join(a.select(*by, F.col("id").alias("left_id"), F.col("words").alias("x")), [*by, "left_id"]).join(b.select(*by, F.col("id").alias("right_id"), F.col("words").alias("y")), [*by, "right_id"])
    dice = 2 * F.size(F.array_intersect("x", "y")) / (F.size("x") + F.size("y"))
    return full.select(*by, "left_id", "right_id", dice.alias("dice")).where(F.col("dice") >= least)
