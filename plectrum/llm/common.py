"""What the operators share: the scratch folder, written intermediate tables and word rules."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the space and the five ASCII line and tab controls.
SPACE_CLASS = r"[ \t-\r]"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a local one, but on no cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark, "_plectrum_shared", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="plectrum-shared-")
        spark._plectrum_shared = base
    return base.rstrip("/")


def made(spark: SparkSession) -> list[str]:
    """The scratch folders of this session, in order."""
    found = getattr(spark, "_plectrum_scratch", None)
    if found is None:
        found = spark._plectrum_scratch = []
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    path = f"{shared_dir(spark)}/plectrum/{name}-{uuid.uuid4().hex}"
    made(spark).append(path)
    return path


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends here."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or of a path without a scheme, else None."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    return uri if uri.startswith("/") else None


def open_for_write(uri: str):
    """A binary stream to a new file in the shared folder, from the driver or an executor."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def read_or_map(uri: str):
    """The bytes of a file in the shared folder: memory-mapped if the folder is mounted, else read."""
    import mmap

    path = local_path(uri)
    if path is not None:
        with open(path, "rb") as f:
            if os.fstat(f.fileno()).st_size == 0:
                return b""
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    with system.open_input_file(inner) as f:
        return f.read()


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def quoted(columns: list[str]) -> list[str]:
    """The names as select() takes them literally, dots included."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, all behind as many underscores as it takes for none to clash with a column."""
    taken = {c.lower() for c in columns}
    while taken & {n.lower() for n in names}:
        names = tuple("_" + n for n in names)
    return list(names)


#: Rows that a scan or a Python worker takes at once: texts run to megabytes, and defaults of thousands of rows
#: make buffers of tens of megabytes in every task.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def bounded_batches(spark: SparkSession) -> None:
    """Batches for tables of long texts, where the session does not set its own."""
    told = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in told:
            spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
