"""Where short needles first stand in a document's texts, each text read once however many needles its document has.

A needle is known by the fingerprint of its first characters.  Each text slides windows of that width over itself,
keeps the places whose fingerprint is one of its document's, and emits the characters behind them; needles and places
meet by document and fingerprint and are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of a fingerprint, and the longest needle.
WIDTH, LONGEST = 8, 60
_BASE = 0x9E3779B97F4A7C15


def _fingerprints(codes: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of each window of ``width`` characters."""
    n = len(codes) - width + 1
    out = np.zeros(max(n, 0), "u8")
    for k in range(width if n > 0 else 0):
        out = out * np.uint64(_BASE) + codes[k : k + n]
    return (out ^ (out >> np.uint64(29))).view("i8")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8") + np.uint64(1)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Needles with the width and fingerprint they are known by."""
    for b in batches:
        needles = b.column("needle").to_pylist()
        widths = [min(len(n), WIDTH) for n in needles]
        prints = [int(_fingerprints(_codes(n[:w]), w)[0]) for n, w in zip(needles, widths, strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(widths, pa.int32()), pa.array(prints, pa.int64())], names=[*b.schema.names, "w", "f"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the windows whose fingerprint its document asks for, with what stands behind them, each once."""
    for b in batches:
        rows, widths, prints, tails = [], [], [], []
        for i, (text, asked) in enumerate(zip(b.column("text").to_pylist(), b.column("asked").to_pylist(), strict=True)):
            codes = _codes(text)
            for width in {a["w"] for a in asked}:
                found = _fingerprints(codes, width)
                at = np.flatnonzero(np.isin(found, np.array([a["f"] for a in asked if a["w"] == width], "i8")))
                most = LONGEST if width == WIDTH else width
                for f, tail in {(int(found[p]), text[p : p + most]) for p in at.tolist()}:
                    rows.append(i)
                    widths.append(width)
                    prints.append(f)
                    tails.append(tail)
        own = b.select(["doc_id", "place"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(widths, pa.int32()), pa.array(prints, pa.int64()), pa.array(tails, pa.string())], names=["doc_id", "place", "w", "f", "tail"])


def first_holding(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, key, place: the least place of the document's texts that hold the needle.

    needles: doc_id, key, needle (at most LONGEST characters); texts: doc_id, place, text.  Empty needles and nulls are nowhere.
    """
    asked = needles.where("needle <> ''").select("doc_id", "key", "needle")
    marked = asked.mapInArrow(_mark, StructType([*asked.schema.fields, *StructType.fromDDL("w int, f long").fields]))
    lists = marked.groupBy("doc_id").agg(F.collect_set(F.struct("w", "f")).alias("asked"))
    read = texts.where("text IS NOT NULL").select("doc_id", "place", "text").join(lists, "doc_id").select("doc_id", "place", "text", "asked")
    schema = StructType([read.schema["doc_id"], read.schema["place"], *StructType.fromDDL("w int, f long, tail string").fields])
    hits = read.mapInArrow(_places, schema).join(marked, ["doc_id", "w", "f"]).where(F.startswith("tail", F.col("needle")))
    return hits.groupBy("doc_id", "key").agg(F.min("place").alias("place"))
