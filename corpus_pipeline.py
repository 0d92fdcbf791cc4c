"""From raw documents to packed training sequences: five stages, each a table for the next.

Every stage works on all rows that the one before kept.  A stage's own scratch tables are dropped
when the next one starts, since its result has been written by then.

Edge cases: a null or empty text scores as the classifier's intercept and is rejected by the quality rules for its few
words; a null doc_id is never dropped as a copy; of rows that share an id and are copies one stays; an empty table stays empty
through every stage; further columns, whatever their names, are carried up to packing, which returns pieces alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectrum.llm import common, jaccard, lines, packing, quality, tokens, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _own_scratch(stage: Stage) -> Stage:
    """The stage, dropping what the last pipeline stage of this session left and noting its own."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bounded_batches(spark)
        common.drop_paths(spark, getattr(spark, "_plectrum_stage", []))
        before = len(common.made(spark))
        out = stage(spark, docs, sf_dir)
        spark._plectrum_stage = common.made(spark)[before:]
        return out

    run.__name__ = stage.__name__
    return run


@_own_scratch
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_own_scratch
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality.filter_quality(docs)


@_own_scratch
def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats over its documents go; n_chars follows the text.

    A group of near copies, as the next stage finds them, counts as one document: what only copies of one text share is that
    text, which shall reach the next stage whole.  Sources of fewer than MIN_PAGES pages lose no line: a share of so few says nothing.
    """
    group = common.free_names(docs.columns, "_group")[0]
    page = F.struct(group, F.when(F.col(group).isNull(), F.struct(F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"))))
    clean = lines.drop_boilerplate(jaccard.with_group(docs, group), F.col("source"), page=page)
    dropped = F.col(clean.columns[-1])
    fresh = F.when(dropped > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", fresh).select(*common.quoted(docs.columns))


@_own_scratch
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays.

    The stage takes the contract of op10: shingles of three words at a similarity of 0.9.
    """
    return jaccard.keep_one(docs)


@_own_scratch
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 2048 ids."""
    return packing.pack(docs, tokens.default_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("quality rules", rules),
    ("line dedup", site_lines),
    ("n-gram Jaccard join", near_copies),
    ("packing", packed),
]

#: Scores, tokens and curve keys are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), common.scratch(spark, "stage-" + name.replace(" ", "-")))
    return docs
