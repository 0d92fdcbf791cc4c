"""Token-id files: flat unsigned integers and 64-bit document offsets, read by memory mapping.

Documents are range-partitioned by id and sorted; each task encodes its range and writes three flat
files: ``.bin`` (ids, 16 bits if the tokenizer's largest id and the end id allow, else 32), ``.idx`` (n + 1 local 64-bit offsets)
and ``.doc`` (64-bit document ids, then one validity byte each).  The manifest has a row for each
file and is itself a written table, so an attempt that was lost or ran twice leaves no trace in it.
A file's base is the sum of the counts before it; the driver sums one number a file.

Edge cases: a null text is empty and gets the end id alone; null ids come first and are read back as null;
rows with equal ids are ordered by a hash of their text and all kept; an empty table gives no files
and no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectrum.llm.common import documents, open_for_write, read_or_map, scratch, written
from plectrum.llm.tokens import default_path, id_width, library_encoder, text_slices, with_end

MANIFEST = "part int, path string, n_docs long, n_tokens long, width int"


def write_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, width: int | None = None) -> DataFrame:
    """Encodes (doc_id, text) into files below folder; the manifest, as a written table.

    width: bytes an id, by default the fewest of 2 and 4 that hold the tokenizer's ids and end_id.
    """
    least = id_width(tokenizer, end_id)
    width = width or least
    if width < least:
        raise ValueError(f"ids of {width} bytes do not hold those of {tokenizer}")
    kind = {2: "<u2", 4: "<u4"}[width]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        path = f"{folder}/ids-{part:06d}-{context.taskAttemptId()}"
        encoder = library_encoder(tokenizer)
        sizes, ids, known, out = [np.zeros(1, "i8")], [], [], None
        for batch in text_slices(batches):
            out = out or open_for_write(path + ".bin")
            column = batch.column("doc_id")
            ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            known.append(column.is_valid().to_numpy(zero_copy_only=False).astype("u1"))
            found, bounds = with_end(*encoder.encode_flat(batch.column("text")), end_id)
            sizes.append(np.diff(bounds))
            out.write(found.astype(kind).tobytes())
        if out is None:
            return
        out.close()
        with open_for_write(path + ".idx") as f:
            offsets = np.cumsum(np.concatenate(sizes)).astype("<i8")
            f.write(offsets.tobytes())
        with open_for_write(path + ".doc") as f:
            f.write(np.concatenate(ids).tobytes() + np.concatenate(known).tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])], "width": pa.array([width], pa.int32())}
        )

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(dealt.mapInArrow(write, MANIFEST), folder + "/manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: doc_id, start over all files, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, kind = row["n_docs"], {2: "<u2", 4: "<u4"}[row["width"]]
                offsets = np.frombuffer(read_or_map(row["path"] + ".idx"), "<i8")
                docs = read_or_map(row["path"] + ".doc")
                ids, known = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, "u1", n, 8 * n)
                tokens = np.frombuffer(read_or_map(row["path"] + ".bin"), kind)
                for a in range(0, n, 8192):
                    b = min(n, a + 8192)
                    crc = [zlib.crc32(tokens[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(ids[a:b], pa.int64(), mask=known[a:b] == 0),
                            "start": pa.array(offsets[a:b] + row["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(offsets[a : b + 1]), pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    spark = manifest.sparkSession
    files, base = [], 0
    for row in manifest.orderBy("part").collect():  # one row a file
        files.append((*row, base))
        base += row["n_tokens"]
    listed = spark.createDataFrame(files, MANIFEST + ", base long").repartition(max(1, len(files)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    return read_files(write_files(documents(spark, sf_dir), folder, default_path(), end_id=2))
