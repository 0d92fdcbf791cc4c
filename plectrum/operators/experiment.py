"""Blind listening experiments: seeded shuffles, side assignment, clips and their balance.

The generator has 32-bit state that grows by a constant, so the i-th number of a seed is an expression in
i and needs no loop.  An experiment's pairs are few (a seed's shuffle walks them in order), so an
experiment is one row while it is assigned; many experiments run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plectrum.functions.spanish import let
from plectrum.functions.text import rounded, units
from plectrum.operators.metrics import balance

# The generator's step, the mask of the second seed, and the letters of clip names.
STEP, SIDE_SEED = 0x6D2B79F5, 0x9E3779B9
ALPHABET = "abcdefghjkmnpqrstuvwxyz23456789"
NAME_LETTERS = 8
_WORD = 0xFFFFFFFF


def _word(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_WORD))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, in two halves so that nothing overflows."""
    high = _word(a * F.shiftrightunsigned(b, 16)).bitwiseAND(F.lit(0xFFFF))
    return _word(F.shiftleft(high, 16) + a * b.bitwiseAND(F.lit(0xFFFF)))


def random_at(seed: Column, i: Column) -> Column:
    """The i-th number, from 0, of a seed: at least 0 and below 1."""
    state = _word(seed.cast("long") + _times(_word(i.cast("long") + 1), F.lit(STEP).cast("long")))

    def first(a: Column) -> Column:
        return _times(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))

    def second(t: Column) -> Column:
        return t.bitwiseXOR(_word(t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))))

    def last(t: Column) -> Column:
        return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)

    return let(state, lambda a: let(first(a), lambda t: let(second(t), last)))


def shuffled(items: Column, seed: Column) -> Column:
    """An array in the order of a seed: from the end, each place is swapped with a drawn one not after it."""
    n = F.size(items)

    def swap(state: Column, at: Column) -> Column:
        i = n - 1 - at

        def with_j(j: Column) -> Column:
            return F.transform(state, lambda x, k: F.when(k == i, F.get(state, j)).when(k == j, F.get(state, i)).otherwise(x))

        return let(F.floor(random_at(seed, at) * (i + 1)).cast("int"), with_j)

    return F.when(n < 2, items).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), items, swap))


def clip_name(seed: Column, first: Column) -> Column:
    """An opaque clip name from eight numbers of a seed, starting at the first-th."""
    letters = F.split(F.lit(ALPHABET), "")
    picks = F.transform(F.sequence(F.lit(0), F.lit(NAME_LETTERS - 1)), lambda k: F.get(letters, F.floor(random_at(seed, first + k) * len(ALPHABET)).cast("int")))
    return F.concat(F.lit("g3a-"), F.array_join(picks, ""))


def assign_sides(pairs: DataFrame, seed: Column) -> DataFrame:
    """experiment, presentation_order, pair, left_clip, right_clip, left_condition for (experiment, pair) rows.

    Each pair takes one number for its side and eight for each clip; a name that an experiment has already
    would be drawn again, which shifts all later draws: with 31^8 names it is an error here instead.
    """
    own = pairs.groupBy("experiment").agg(F.sort_array(F.collect_list("pair")).alias("_pairs"))
    order = own.select("experiment", F.posexplode(shuffled(F.col("_pairs"), seed)).alias("presentation_order", "pair"))
    second = F.lit(SIDE_SEED).bitwiseXOR(_word(seed.cast("long")))
    at = F.col("presentation_order") * (1 + 2 * NAME_LETTERS)
    left = F.when(random_at(second, at) < 0.5, "gold").otherwise("literal")
    named = order.select(
        "experiment", "presentation_order", "pair", clip_name(second, at + 1).alias("left_clip"), clip_name(second, at + 1 + NAME_LETTERS).alias("right_clip"), left.alias("left_condition")
    )
    return named


def clips(assignments: DataFrame, pairs: DataFrame) -> DataFrame:
    """experiment, clip, pair, side, condition, text: two clips an assignment.

    pairs: experiment, pair, literal_text, gold_text.
    """
    other = F.when(F.col("left_condition") == "gold", "literal").otherwise("gold")
    each = F.array(
        F.struct(F.col("left_clip").alias("clip"), F.lit("left").alias("side"), F.col("left_condition").alias("condition")),
        F.struct(F.col("right_clip").alias("clip"), F.lit("right").alias("side"), other.alias("condition")),
    )
    out = assignments.join(pairs, ["experiment", "pair"]).select("experiment", "pair", "literal_text", "gold_text", F.inline(each))
    return out.select("experiment", "clip", "pair", "side", "condition", F.when(F.col("condition") == "gold", F.col("gold_text")).otherwise(F.col("literal_text")).alias("text"))


def clip_balance(clips_: DataFrame) -> DataFrame:
    """experiment, pair, char_ratio, duration_ratio (null without audio) and matched (no ratio above two)."""
    side = lambda s, v: F.max(F.when(F.col("side") == s, v))
    size = units(F.col("text"))
    audio = F.col("audio_ms") if "audio_ms" in clips_.columns else F.lit(None).cast("long")
    own = clips_.groupBy("experiment", "pair").agg(side("left", size).alias("a"), side("right", size).alias("b"), side("left", audio).alias("x"), side("right", audio).alias("y"))
    chars = F.when(F.least("a", "b") > 0, rounded(F.greatest("a", "b") / F.least("a", "b"), 2))
    ratio = F.when((F.col("x") > 0) & (F.col("y") > 0), balance(F.col("x"), F.col("y")))
    return own.select("experiment", "pair", chars.alias("char_ratio"), ratio.alias("duration_ratio"), (F.coalesce(ratio, F.lit(0.0)) <= 2.0).alias("matched"))


def questions_for(questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The questions whose block is among the pairs."""
    return questions.join(pairs.select("block_id").distinct(), "block_id", "left_semi")
