"""Session defaults shared by the benchmark, the tests and interactive use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that the plans in this package assume or profit from.  A cluster overrides the sizes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "plectrum", **conf: str) -> SparkSession:
    """A session with the package defaults; keyword settings use ``_`` for ``.`` and win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {key.replace("_", "."): value for key, value in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows that a Python worker takes at once: audio and texts are large, and the default of ten thousand rows fills its memory.
ARROW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}


def small_batches(spark: SparkSession) -> None:
    """Small batches for Python workers, where the session does not set its own; the setting stays, since results are lazy."""
    told = spark.conf.getAll
    for key, value in ARROW_ROWS.items():
        if key not in told:
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_plectrum_folder", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = spark._plectrum_folder = "file://" + tempfile.mkdtemp(prefix="plectrum-")
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_folder(spark)}/plectrum/{name}-{uuid.uuid4().hex}"
