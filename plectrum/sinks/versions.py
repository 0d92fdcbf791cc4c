"""Keyed tables that change by versions: a save writes new files beside the old ones and then one manifest.

Rows lie in buckets by a hash of their key.  A version is a numbered manifest that names the folder of each bucket, so it has a
bounded size.  A save reads and rewrites the buckets that its keys fall into and no others, then creates the next manifest;
creation fails if another writer was first, and the save starts again on that writer's version.  A reader pins the
version it began with: files are never changed, so what it reads cannot mix two versions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Versions:
    """A table below ``folder`` with one row a key; ``order`` tells which of two rows of a key is the later one."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, order: Column, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.key, self.order, self.buckets = spark, folder.rstrip("/"), schema, key, order, buckets

    # --- manifests

    def _path(self, *names: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of the manifests that are there."""
        path, system = self._path("manifests")
        if not system.exists(path):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in system.listStatus(path) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("."))

    def current(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict[int, str]:
        """Bucket to folder; version 0 is the empty table."""
        if not version:
            return {}
        path, _ = self._path("manifests", f"{version:012d}.json")
        (text,) = (r[0] for r in self.spark.read.text(str(path.toString()), wholetext=True).collect())
        return {int(k): v for k, v in json.loads(text).items()}

    def _publish(self, version: int, manifest: dict[int, str]) -> bool:
        """Makes the manifest of a version at once; False if the version is there already."""
        body = bytearray(json.dumps(manifest).encode())
        draft, system = self._path("manifests", f".draft-{uuid.uuid4().hex}")
        out = system.create(draft, True)
        out.write(body)
        out.close()
        final, _ = self._path("manifests", f"{version:012d}.json")
        lock, _ = self._path("manifests", f".lock-{version:012d}")
        if system.exists(final) or not system.createNewFile(lock):  # one writer of a version
            system.delete(draft, False)
            return False
        return bool(system.rename(draft, final))

    # --- reading

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, by default the newest; of some buckets alone."""
        told = self.manifest(self.current() if version is None else version)
        paths = sorted(p for b, p in told.items() if buckets is None or b in set(buckets))
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{p}" for p in paths])

    def get(self, *keys: object, version: int | None = None) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        return self.read(version, self._buckets_of(wanted)).join(wanted, self.key, "left_semi")

    # --- changing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most ``buckets``

    def _change(self, rows: DataFrame, merged, tries: int) -> int:
        touched = self._buckets_of(rows)
        if not touched:
            return self.current()
        for _ in range(tries):
            base = self.current()
            name = uuid.uuid4().hex
            new = merged(self.read(base, touched)).withColumn("_bucket", self._bucket())
            new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/data/{name}")
            path, system = self._path("data", name)
            left = {int(s.getPath().getName().split("=")[1]) for s in system.listStatus(path) if "=" in s.getPath().getName()}
            told = {b: p for b, p in self.manifest(base).items() if b not in touched}
            if self._publish(base + 1, told | {b: f"{name}/_bucket={b}" for b in left}):
                return base + 1
            system.delete(path, True)
        raise RuntimeError(f"{tries} saves came in between")

    def save(self, rows: DataFrame, tries: int = 8) -> int:
        """Upserts rows: of a key's rows, stored and new, the last in order stays.  Returns the new version."""
        rows = rows.select(*self.schema.names)
        row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in self.schema.names])

        def merged(stored: DataFrame) -> DataFrame:
            both = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
            return both.groupBy(self.key).agg(F.max_by(row, F.struct(self.order, "_new")).alias("_last")).select("_last.*")

        return self._change(rows, merged, tries)

    def remove(self, keys: DataFrame, tries: int = 8) -> int:
        """Takes the rows of the keys away."""
        return self._change(keys, lambda stored: stored.join(keys.select(self.key), self.key, "left_anti").select(*self.schema.names), tries)

    def vacuum(self, keep: int = 2) -> int:
        """Drops manifests but the newest ``keep`` and the folders that none of these names; readers of older versions end."""
        held = self.versions()
        used = {p for v in held[-keep:] for p in self.manifest(v).values()}
        for v in held[:-keep]:
            path, system = self._path("manifests", f"{v:012d}.json")
            system.delete(path, False)
        path, system = self._path("data")
        gone = 0
        for write in system.listStatus(path) if system.exists(path) else []:
            for bucket in system.listStatus(write.getPath()):
                name = f"{write.getPath().getName()}/{bucket.getPath().getName()}"
                if "=" in name and name not in used:
                    system.delete(bucket.getPath(), True)
                    gone += 1
        return gone
