"""Writers: result files, CSV packets and the audio cache."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectrum.functions.requests import csv_line
from plectrum.operators.serving import upsert


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    """A small file from the driver, wherever the URI points."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(conf).create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_result(spark: SparkSession, uri: str, payload: object) -> None:
    """A report as indented JSON with a final line feed."""
    write_text(spark, uri, json.dumps(payload, indent=2, ensure_ascii=False) + "\n")


def write_csv(df: DataFrame, folder: str) -> None:
    """df as CSV with a header in each part; fields are quoted only where they must be."""
    lines = df.select(csv_line(*[F.col(f"`{c}`") for c in df.columns]).alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\n").text(folder)
    head = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\n') else c for c in df.columns)
    write_text(df.sparkSession, folder.rstrip("/") + "/_header", head + "\n")


def write_audio_cache(entries: DataFrame, folder: str) -> None:
    """Cache entries (key, audio, mime, boundaries) by the first two characters of their key; an entry is never changed."""
    entries.withColumn("shard", F.substring("key", 1, 2)).write.mode("append").partitionBy("shard").parquet(folder)


def read_audio_cache(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """Entries of the cache; with keys, of their shards alone.  A key written twice is one entry."""
    found = spark.read.parquet(folder)
    if keys:
        found = found.where(F.col("shard").isin(*sorted({k[:2] for k in keys})) & F.col("key").isin(*keys))
    return found.dropDuplicates(["key"]).drop("shard")


def save_positions(stored: DataFrame, saved: DataFrame, folder: str) -> DataFrame:
    """Positions with later saves in place of earlier ones, written to a fresh folder."""
    last = upsert(stored, saved, "fingerprint", F.col("saved_at"))
    last.write.mode("errorifexists").parquet(folder)
    return stored.sparkSession.read.schema(last.schema).parquet(folder)
