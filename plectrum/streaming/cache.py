"""A write-through cache behind a stream: each batch probes it, makes what it lacks once, and saves that.

A batch's new entries go to a folder named by the batch, and a ledger notes the batch once they are there, so that a batch
which Spark hands over again (after a failure between the sink and the checkpoint) reads its outcome back and writes
nothing.  Saving is not part of the answer: where it fails the batch answers all the same and tells so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

Make = Callable[[DataFrame], DataFrame]


def _exists(spark: SparkSession, uri: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _touch(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True).close()


class WriteThrough:
    """``make`` turns rows of keys into the keys with their value columns; ``ttl_ms`` after it was saved an entry is a miss.

    rows: the schema of the requests, with a key, a time in epoch milliseconds and an order among equal times.  An instance
    is a function for ``foreachBatch``; every request is answered with its values and one of these outcomes: ``cache_hit``;
    ``generated`` for the first request of a new key, ``cache_write_failed`` if that could not be saved; ``joined`` for
    others of the same batch; ``provider_error`` where nothing was made, as for a null key.
    """

    def __init__(self, spark: SparkSession, folder: str, rows: StructType, key: str, ms: str, order: str, make: Make, values: StructType, ttl_ms: int | None = None) -> None:
        self.spark, self.folder, self.rows, self.values, self.ttl_ms = spark, folder.rstrip("/"), rows, values, ttl_ms
        self.key, self.ms, self.order, self.make = key, ms, order, make

    def _read(self, what: str, schema: StructType) -> DataFrame:
        place, told = f"{self.folder}/{what}", StructType([*schema.fields]).add("batch", LongType())
        if not _exists(self.spark, place):
            return self.spark.createDataFrame([], told)
        return self.spark.read.schema(told).option("basePath", place).parquet(place + "/batch=*")

    def entries(self, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """key, saved_ms, value columns: the last entry of each key, of the batches that the ledger holds; of some keys and earlier batches alone."""
        found = self._read("entries", StructType([self.rows[self.key], *StructType().add("saved_ms", LongType()).fields, *self.values.fields]))
        found = found.join(self._read("ledger", StructType().add("n", IntegerType())), "batch", "left_semi")
        if before is not None:
            found = found.where(F.col("batch") < before)
        if keys is not None:
            found = found.join(keys, self.key, "left_semi")
        last = F.max_by(F.struct("saved_ms", *self.values.names), F.struct("saved_ms", "batch")).alias("_e")
        return found.groupBy(self.key).agg(last).select(self.key, "_e.*")

    def _save(self, fresh: DataFrame, batch_id: int) -> DataFrame | None:
        """The entries as they were saved, now or when the batch first came; None if they cannot be."""
        place, ledger = (f"{self.folder}/{x}/batch={batch_id}" for x in ("entries", "ledger"))
        try:
            if not _exists(self.spark, ledger + "/_SUCCESS"):
                fresh.write.mode("overwrite").parquet(place)
                self.spark.range(1).select(F.col("id").cast("int").alias("n")).write.mode("overwrite").parquet(ledger)
            return self.spark.read.schema(fresh.schema).parquet(place)
        except Exception:  # noqa: BLE001 - whatever the store's failure, the answer does not depend on it
            return None

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        answer = f"{self.folder}/answers/batch={batch_id}"
        if _exists(self.spark, answer + "/_SUCCESS"):
            return  # handed over again
        rows = rows.persist()
        try:
            self._answer(rows, batch_id).write.mode("overwrite").parquet(answer)
        finally:
            rows.unpersist()

    def _answer(self, rows: DataFrame, batch_id: int) -> DataFrame:
        at = F.struct(F.col(self.ms).alias("ms"), F.col(self.order).alias("order"))
        firsts = rows.groupBy(self.key).agg(F.min(at).alias("_first"))
        live = self.entries(firsts, batch_id)
        if self.ttl_ms is not None:
            live = live.join(firsts, self.key).where(F.col("_first.ms") - F.col("saved_ms") <= self.ttl_ms).drop("_first")
        missing = firsts.where(F.col(self.key).isNotNull()).join(live, self.key, "left_anti")
        made = self.make(missing.select(self.key)).select(self.key, *self.values.names)
        fresh = missing.join(made, self.key).select(self.key, F.col("_first.ms").alias("saved_ms"), *self.values.names)
        saved = self._save(fresh, batch_id)
        new = fresh if saved is None else saved
        mark = lambda df, told: df.select(self.key, *self.values.names, F.lit(told).alias("_told"))
        known = mark(new, "cache_write_failed" if saved is None else "generated").unionByName(mark(live, "cache_hit"))
        told = rows.join(firsts, self.key, "left").join(known, self.key, "left")
        joined = ~F.col("_told").isin("cache_hit") & (at != F.col("_first"))
        outcome = F.when(F.col("_told").isNull(), "provider_error").when(joined, "joined").otherwise(F.col("_told"))
        return told.select(*self.rows.names, *self.values.names, outcome.alias("outcome"))

    def answers(self) -> DataFrame:
        """The requests of all batches with their values, outcome and batch."""
        return self._read("answers", StructType([*self.rows.fields, *self.values.fields]).add("outcome", StringType()))
