"""The queries of this subpackage and their DuckDB equivalents, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plectrum.llm import bpe, chat, fill_middle, jaccard, lines, media, oracle, packing, quality, secret_scan, sharding, token_files, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "pipeline": _pipeline,
        "op1_chat_format": chat.query,
        "op2_media_columns": media.query,
        "op3_quality_rules": quality.query,
        "op4_token_files": token_files.query,
        "op5_resharding": sharding.query,
        "op6_packing": packing.query,
        "op7_line_dedup": lines.query,
        "op8_bpe_lexicon": bpe.query,
        "op9_toxicity": toxicity.query,
        "op10_ngram_jaccard": jaccard.query,
        "op11_secret_scan": secret_scan.query,
        "op12_fill_middle": fill_middle.query,
        "op13_whitening": whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
