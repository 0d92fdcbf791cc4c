"""Replays a table as a stream of batches, from checkpoint to checkpoint, as a service restarted after each batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plectrum.session import fresh_folder

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, told: dict[str, str]) -> Iterator[None]:
    """Settings that hold within the block alone."""
    before = {k: spark.conf.get(k, None) for k in told}
    try:
        for k, v in told.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def staged(rows: DataFrame, batch: str, folder: str) -> list[int]:
    """Writes the rows once, a folder a batch, and gives the batches in order."""
    rows.write.partitionBy(batch).parquet(folder)
    found = rows.sparkSession.read.schema(rows.schema).parquet(folder).select(batch).distinct().collect()  # a row a batch
    return sorted(r[0] for r in found)


def _moved(spark: SparkSession, old: str, new: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(new)
    system = path.getFileSystem(conf)
    system.mkdirs(path.getParent())
    if not system.rename(jvm.org.apache.hadoop.fs.Path(old), path):
        raise OSError(f"cannot move {old} to {new}")


def feed(rows: DataFrame, batch: str, start: Callable[[DataFrame, str], StreamingQuery], name: str, timeout_s: int = 600) -> str:
    """Hands the rows to a stream, batch by batch; ``start`` gets the streaming rows and a checkpoint folder and starts a query.

    Each batch is a run of its own that takes up the state of the one before.  Returns the folder of the replay.
    """
    spark, folder = rows.sparkSession, fresh_folder(rows.sparkSession, name)
    order = staged(rows, batch, folder + "/staged")
    schema = rows.drop(batch).schema
    with settings(spark, ROCKS):
        for i, b in enumerate(order):
            _moved(spark, f"{folder}/staged/{batch}={b}", f"{folder}/in/{i:06d}")
            source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder + "/in")
            query = start(source, folder + "/checkpoint")
            try:
                if not query.awaitTermination(timeout_s):
                    raise TimeoutError(f"batch {b} of {name} took more than {timeout_s} s")
            finally:
                query.stop()
    return folder


def _width(spark: SparkSession) -> dict[str, str]:
    """State in two partitions a core at most: each takes a worker of Python and a store that is opened and saved in every batch, however little it holds."""
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return {"spark.sql.shuffle.partitions": str(min(asked, 2 * spark.sparkContext.defaultParallelism))}


def replayed(rows: DataFrame, batch: str, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What the stream ``build`` makes of the rows emits over all batches."""
    spark = rows.sparkSession
    schema: list = []

    def start(source: DataFrame, checkpoint: str) -> StreamingQuery:
        out = build(source)
        schema[:] = [out.schema]
        sink = out.writeStream.format("parquet").option("path", checkpoint.rsplit("/", 1)[0] + "/out").outputMode("append")
        return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    with settings(spark, _width(spark)):
        folder = feed(rows, batch, start, name)
    if not schema:
        return spark.createDataFrame([], build(_empty_stream(rows.drop(batch), folder)).schema)
    return spark.read.schema(schema[0]).parquet(folder + "/out")


def _empty_stream(rows: DataFrame, folder: str) -> DataFrame:
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.parquet(folder + "/in")
    return spark.readStream.schema(rows.schema).parquet(folder + "/in")


def delayed(rows: DataFrame, ms: str, delay_ms, width_ms: int) -> DataFrame:
    """rows plus _batch: the span of width_ms in which a row arrives, delay_ms after its time."""
    return rows.withColumn("_batch", F.floor((F.col(ms) + delay_ms) / width_ms).cast("long"))
