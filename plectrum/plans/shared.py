"""What the query modules share: tables of a folder and a registry of queries with their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A to z in capitals, the one change of case on which Spark and DuckDB agree for every text.
CAPITALS_SQL = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"

Query = Callable[[SparkSession, str], DataFrame]


class Registered:
    """Queries by name, and the DuckDB SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def capitals(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Thin rows that much work waits for, dealt out by keys over four times the cluster's width: a file of few bytes would be one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with its time in milliseconds."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", ms.alias("ms"))
