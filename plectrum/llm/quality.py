"""Quality rules: a threshold table compiled into one projection of text ratios.

Everything is a built-in expression over the row's own text: nothing is shuffled, no user function
runs, and a copied or hot group costs no more than any other rows.

Edge cases: a null text has no words; an empty text fails the length rule; repeated rows are judged
one by one; an empty table gives an empty table; where a kept column has a metric's name, :func:`measure` puts
underscores before all metrics and :func:`judge` is told so by ``mark``; :func:`filter_quality` returns the input's own columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plectrum.llm.common import SPACE_CLASS, free_names, quoted, words

#: Symbols that prose hardly uses (fixed by the contract).
SYMBOLS = r"[#*$%&|<>]"

#: Function words of the four languages of the corpus, lower case (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "on", "as", "with", "was", "be", "by", "at",
    "or", "an", "this", "from", "are",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "dans", "pour", "sur",
    "der", "die", "und", "den", "das", "von", "zu", "mit", "sich", "auf", "ist", "für",
    "el", "los", "se", "las", "por", "del", "y", "su", "con", "lo",
)


@dataclass(frozen=True)
class Rule:
    """Keep a row while ``low <= metric <= high``; an open side is None."""

    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self, mark: str = "") -> Column:
        tests = []
        if self.low is not None:
            tests.append(F.col(mark + self.metric) >= F.lit(self.low))
        if self.high is not None:
            tests.append(F.col(mark + self.metric) <= F.lit(self.high))
        out = tests[0] if tests else F.lit(True)
        for t in tests[1:]:
            out = out & t
        return out


#: The production thresholds.  Ratios are per word or per line.
RULES = (
    Rule("n_words", low=50),
    Rule("repeat_word_ratio", high=0.5),
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_ratio", high=0.1),
    Rule("exclaim_ratio", high=0.3),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
)


def _repeat_words(grams: Column) -> Column:
    """Words covered by the 3-word windows whose hash stands at least twice in ``grams``.

    Sorting (hash, place) pairs puts equal windows side by side, so one pass marks them; the union of
    the marked windows [p, p+2] has min(3, gap to the next mark) words a mark and 3 for the last.
    """

    def marked(pairs: Column) -> Column:
        def place(p: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(pairs, i - 1)["g"])
            after = F.get(pairs, i + 1)["g"]
            return F.when(p["g"].eqNullSafe(before) | p["g"].eqNullSafe(after), p["i"])

        return F.sort_array(F.filter(F.transform(pairs, place), lambda x: x.isNotNull()))

    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    # transform over a one-element array binds a value once, however often the lambda uses it
    spots = F.transform(F.array(pairs), marked)
    covered = F.transform(
        spots,
        lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda acc, x: acc + x,
        ),
    )
    return F.get(covered, F.lit(0))


def measure(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The metrics of every whole text beside the ``keep`` columns."""
    row = F.struct(F.lit(0).alias("\0"), *[F.col(q).alias(c) for q, c in zip(quoted(list(keep)), keep, strict=True)])
    found = _metrics(df.select(row.alias("_row"), F.coalesce(F.col(*quoted([text])), F.lit("")).alias("_t")))
    names = free_names(list(keep), *found.columns[1:])
    return found.select(*[F.col("_row").getField(c).alias(c) for c in keep], *[F.col(c).alias(n) for c, n in zip(found.columns[1:], names, strict=True)])


def _metrics(step: DataFrame) -> DataFrame:
    """_row and the metrics of _t."""
    step = step.select(
        "_row",
        "_t",
        words(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:]}")).alias("_lines"),
    )
    step = step.select(
        "_row",
        "_t",
        "_w",
        "_lines",
        F.size("_w").alias("_n"),
        F.slice(
            F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))),
            F.lit(1),
            F.greatest(F.size("_w") - 2, F.lit(0)),
        ).alias("_g"),
    )
    step = step.select(
        "_row",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0).cast("long"))
        .otherwise(_repeat_words(F.col("_g")))
        .alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_exclaims"),
        F.size(F.filter("_w", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    each = F.greatest(F.col("n_words"), F.lit(1))
    return step.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / each,
            "symbol_ratio": F.col("n_symbols") / each,
            "exclaim_ratio": F.col("n_exclaims") / each,
            "stop_word_ratio": F.col("n_stop_words") / each,
            "repeat_word_ratio": F.col("n_repeat_words") / each,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        }
    )


def judge(metrics: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "") -> DataFrame:
    """Adds base_failed, the names of the rules that a row breaks, and kept; ``mark`` stands before all these names."""
    base = (F.col(mark + "n_words") < 50) | (F.lit(100) * F.col(mark + "n_repeat_words") > F.lit(50) * F.col(mark + "n_words"))
    broken = F.array_compact(F.array(*[F.when(~r.passes(mark), F.lit(r.metric)) for r in rules]))
    return metrics.withColumn(mark + "base_failed", base).withColumn(mark + "broken_rules", broken).withColumn(
        mark + "kept", ~F.col(mark + "base_failed") & (F.size(mark + "broken_rules") == 0)
    )


def filter_quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of df that pass every rule, with df's own columns."""
    boxed = df.select(F.struct(*[F.col(c) for c in quoted(df.columns)]).alias("_row"), F.coalesce(F.col(*quoted([text])), F.lit("")).alias("_t"))
    judged = judge(_metrics(boxed), rules).withColumn("_once", F.monotonically_increasing_id())
    # a predicate does not move below a non-deterministic column: the metrics are computed once, not inlined into it
    return judged.where("kept AND _once >= 0").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(measure(docs, "doc_id"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_exclaims", "n_stop_words"
    )
