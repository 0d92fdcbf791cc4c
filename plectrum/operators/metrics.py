"""Evaluation metrics: word-multiset similarity, block matching, exact percentiles, audits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plectrum.functions.spanish import let
from plectrum.functions.text import normalized, rounded, units, word_tokens
from plectrum.operators.ranks import at_ranks, percentiles
from plectrum.operators.similar import similar_pairs


def dice_pairs(left: DataFrame, right: DataFrame, least: float, digits: int = 4) -> DataFrame:
    """(left_id, right_id, dice) of pairs at or above least, from tables (id, text); texts without a word have no pair here."""
    found = similar_pairs(left, right, least)
    return found.select("left_id", "right_id", rounded(F.col("dice"), digits).alias("dice"))


def dice(a: Column, b: Column) -> Column:
    """Sørensen–Dice of two texts' word multisets in one row; 1 if neither has a word."""
    both = F.struct(F.array_sort(word_tokens(a)).alias("x"), F.array_sort(word_tokens(b)).alias("y"))

    def count(words: Column, back: Column, w: Column) -> Column:
        """How often a word stands in a sorted array: between its first and its last place."""
        first = F.array_position(words, w)
        return F.when(first > 0, F.size(words) + 2 - first - F.array_position(back, w)).otherwise(F.lit(0))

    def score(s: Column) -> Column:
        def shared(back: Column) -> Column:
            each = F.transform(F.array_intersect(s["x"], s["y"]), lambda w: F.least(count(s["x"], back["x"], w), count(s["y"], back["y"], w)))
            return F.aggregate(each, F.lit(0).cast("long"), lambda acc, n: acc + n)

        total = F.size(s["x"]) + F.size(s["y"])
        back = F.struct(F.reverse(s["x"]).alias("x"), F.reverse(s["y"]).alias("y"))
        return F.when(total == 0, F.lit(1.0)).otherwise(2 * let(back, shared) / total)

    return let(both, score)


def dice_of_groups(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """by, dice of all words of each group's texts on the left and on the right; words are counted, never collected.

    Groups without a row on the left have none here; 1 if neither side has a word.
    """
    words = lambda df, a, b: df.select(by, F.explode_outer(word_tokens(F.coalesce("text", F.lit("")))).alias("w"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    each = words(left, 1, 0).unionByName(words(right, 0, 1)).groupBy(by, "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    word = F.col("w").isNotNull()
    of = lambda c: F.coalesce(F.sum(F.when(word, c)), F.lit(0))
    sums = each.groupBy(by).agg(of(F.least("a", "b")).alias("both"), of(F.col("a") + F.col("b")).alias("n"), F.sum("a").alias("left"))
    return sums.where(F.col("left") > 0).select(by, F.when(F.col("n") == 0, 1.0).otherwise(2 * F.col("both") / F.col("n")).alias("dice"))


def greedy_match(scores: DataFrame, least: float = 0.55) -> DataFrame:
    """One-to-one matches in reference order: the best free candidate, the first of equals.

    scores: doc_id, ref (order), got (order), dice.  Assignments depend on one another, so a document's candidates are
    sorted in its partition and taken as they are read: what is held is the matches of one document.
    """
    schema = StructType([scores.schema["doc_id"], *StructType.fromDDL("ref long, got long, dice double").fields])
    kinds = to_arrow_schema(schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, done, used, first = None, None, set(), True
        for batch in batches:
            taken = []
            for i, (key, ref, got) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if first or key != doc:
                    doc, done, used, first = key, None, set(), False
                if ref != done and got not in used:
                    used.add(got)
                    done = ref
                    taken.append(i)
            yield batch.take(pa.array(taken, "int32")).cast(kinds)

    fine = scores.where((F.col("dice") >= least) & ~F.isnan("dice") & F.col("ref").isNotNull())
    own = fine.select("doc_id", F.col("ref").cast("long").alias("ref"), F.col("got").cast("long").alias("got"), F.col("dice").cast("double").alias("dice"))
    return own.repartition("doc_id").sortWithinPartitions("doc_id", "ref", F.desc("dice"), "got").mapInArrow(assign, schema)


def upper_percentiles(df: DataFrame, value: str, ps: tuple[float, ...], *by: str) -> DataFrame:
    """by, p, value: sorted[min(n - 1, floor(n * p))] by counts of distinct values, so a group of many equal values is few rows.

    Values are counted where they lie and only counts are shuffled and cumulated; without groups see :mod:`ranks`.
    """
    if not by:
        return percentiles(df, {value: ps}).select("p", F.col("value").cast(df.schema[value].dataType).alias(value))
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    ranked = counted.withColumns({"_to": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    each = ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.col("p")))
    return each.where((at < F.col("_to")) & (at >= F.col("_to") - F.col("_c"))).select(*by, "p", value)


def mode_first(df: DataFrame, value: Column, order: str, *by: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first."""
    counted = df.groupBy(*by, value.alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*by).agg(F.max_by("mode", F.struct(F.col("n"), (-F.col("first").cast("double")).alias("first"))).alias("mode"), F.max("n").alias("n"))


def monotonic(matches: DataFrame) -> DataFrame:
    """Whether the matched places rise with the reference order, a document."""
    w = Window.partitionBy("doc_id").orderBy("ref")
    step = matches.withColumn("_step", F.col("got") - F.lag("got").over(w))
    return step.groupBy("doc_id").agg((F.coalesce(F.min("_step"), F.lit(0)) >= 0).alias("in_order"))


def extraction_metrics(reference: DataFrame, extracted: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document: recall, mean similarity, page accuracy, typing and missed blocks.

    reference, extracted: doc_id, ord, type, text, page; matches: doc_id, ref, got, dice.
    """
    ref = reference.select("doc_id", F.col("ord").cast("long").alias("ref"), F.col("type").alias("ref_type"), F.col("page").alias("ref_page"))
    got = extracted.select("doc_id", F.col("ord").cast("long").alias("got"), F.col("type").alias("got_type"), F.col("page").alias("got_page"))
    all_refs = ref.join(matches, ["doc_id", "ref"], "left").join(got, ["doc_id", "got"], "left")
    hit = F.col("dice").isNotNull()
    return all_refs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(hit).alias("matched"), rounded(F.count_if(hit) / F.count(F.lit(1)), 3).alias("content_recall"),
        rounded(F.avg("dice"), 3).alias("text_fidelity"), rounded(F.count_if(F.col("ref_page") == F.col("got_page")) / F.nullif(F.count_if(hit), F.lit(0)), 3).alias("page_accuracy"),
        F.count_if(hit & (F.col("ref_type") == F.col("got_type"))).alias("typed_right"), F.count_if(~hit).alias("missed"),
    )


def chrome_recovered(reference: DataFrame, extracted: DataFrame) -> DataFrame:
    """Reference furniture whose normalised text some extracted block has."""
    own = extracted.select("doc_id", normalized(F.col("text")).alias("_key"))
    return reference.withColumn("_key", normalized(F.col("text"))).join(own, ["doc_id", "_key"], "left_semi").drop("_key")


def gold_agreement(gold: DataFrame, segments: DataFrame) -> DataFrame:
    """Mean of the rounded similarities of manual and spoken texts and exact matches, a document."""
    both = gold.join(segments, ["doc_id", "block_id"])
    d = rounded(dice(F.col("gold_text"), F.col("spoken_text")), 3)
    exact = normalized(F.col("gold_text")) == normalized(F.col("spoken_text"))
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"), rounded(F.avg(d), 3).alias("mean_dice"), F.count_if(exact).alias("exact"))


def rule_coverage(segments: DataFrame, total: int) -> DataFrame:
    fired = segments.select("doc_id", F.explode("transformations").alias("t")).groupBy("doc_id").agg(F.count_distinct("t.rule").alias("fired"))
    return fired.withColumn("share", rounded(F.col("fired") / F.lit(total), 3))


def balance(a: Column, b: Column) -> Column:
    """The larger over the smaller, to two digits; NaN unless both are positive."""
    return F.when((a > 0) & (b > 0), rounded(F.greatest(a, b) / F.least(a, b), 2)).otherwise(F.lit(float("nan")))


def stratified_sample(df: DataFrame, text: str, order: list[str], wanted: int) -> DataFrame:
    """Systematic picks from short (<120), middle (<=260) and long texts, duplicates out, first wins; adds ``stratum``.

    The feature is a sample: quotas are ceil(.3), ceil(.4) and the rest of wanted.  Texts travel as digests with the
    number of their first row; ranks within a stratum come from counts by ranges, and only the picked rows are read again.
    order: whole numbers that name a row, the first of them not null.
    """
    size = units(F.col(text))
    label = F.when(size < 120, "short").when(size <= 260, "mid").otherwise("long")
    place = F.struct(*[F.col(c).cast("long").alias(f"o{i}") for i, c in enumerate(order)])
    first = df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("_d"), label.alias("stratum")).agg(F.min(place).alias("_o"))
    short, mid = -(-3 * wanted // 10), -(-4 * wanted // 10)
    quota = F.when(F.col("key") == "short", short).when(F.col("key") == "mid", mid).otherwise(max(0, wanted - short - mid))
    q = F.least(quota, F.col("n")).cast("int")
    spaced = F.when(q > 0, F.transform(F.sequence(F.lit(0), q - 1), lambda i: F.floor(i * F.col("n") / q))).otherwise(F.array().cast("array<long>"))
    picked = at_ranks(first.select(F.col("stratum").alias("key"), F.col("_o.o0").alias("value"), F.col("_o").alias("tie"), F.lit(1).cast("long").alias("count")), spaced)
    names = picked.select(F.col("key").alias("stratum"), *[F.col(f"tie.o{i}").alias(f"_o{i}") for i in range(len(order))])  # ``wanted`` rows at most
    same = [F.col(c).cast("long").eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(order)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    found = df.join(F.broadcast(names), on).where(label == F.col("stratum"))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], "stratum").dropDuplicates(["stratum", *order])
