"""Provider-sized speech chunks: greedy packing of segments, long ones split at sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plectrum.functions.text import SPACE, blank, units
from plectrum.session import small_batches

_CLASS = "[" + re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), SPACE) + "]"
_NOT = "[^" + _CLASS[1:]
_SENTENCE, _COMMA = re.compile(rf"[.!?…]{_CLASS}+{_NOT}"), re.compile(rf",{_CLASS}+{_NOT}")
_EDGES = re.compile(rf"^{_CLASS}+|{_CLASS}+\Z")
_SPACE_UNIT = re.compile(_CLASS)


def split_long(text: str, limit: int) -> list[str]:
    """Pieces of at most limit UTF-16 units: the last sentence end, else comma, else space, else a hard cut.

    The text is encoded once and read window by window, so the work is linear in it.
    """
    data, out, at = text.encode("utf-16-le", "surrogatepass"), [], 0
    size = len(data)
    while size - at > 2 * limit:
        window = data[at : at + 2 * limit].decode("utf-16-le", "surrogatepass")
        end = None
        for pattern in (_SENTENCE, _COMMA):
            if hits := [m.start() for m in pattern.finditer(window)]:
                end = hits[-1] + 2
                break
        if end is None and (blank_at := window.rfind(" ")) >= 0:
            end = blank_at + 1
        cut = at + (2 * limit if end is None else len(window[:end].encode("utf-16-le", "surrogatepass")))
        if 0xD8 <= data[cut - 1] <= 0xDB and 0xDC <= data[cut + 1] <= 0xDF:
            cut -= 2
        out.append(_EDGES.sub("", data[at:cut].decode("utf-16-le", "surrogatepass")))
        at = cut
        while at < size and _SPACE_UNIT.match(data[at : at + 2].decode("utf-16-le", "surrogatepass")):
            at += 2
    if at < size:
        out.append(data[at:].decode("utf-16-le", "surrogatepass"))
    return [p for p in out if p]


def pieces(segments: DataFrame, limit: int) -> DataFrame:
    """Heard segments as pieces in order: doc_id, ord, part, segment_id, piece.  Only long texts see Python."""

    def split(texts: "pd.Series") -> "pd.Series":
        return texts.map(lambda t: split_long(t, limit))

    small_batches(segments.sparkSession)
    heard = segments.where(~F.col("muted") & ~blank(F.col("spoken_text")))
    long = units(F.col("spoken_text")) > limit
    cut = F.pandas_udf(split, "array<string>")
    short = heard.where(~long).select("doc_id", "ord", F.lit(0).alias("part"), "segment_id", F.col("spoken_text").alias("piece"))
    rest = heard.where(long).select("doc_id", "ord", "segment_id", cut("spoken_text").alias("p"))
    return short.unionByName(rest.select("doc_id", "ord", F.posexplode("p").alias("part", "piece"), "segment_id"))


class _Chunk:
    """Pieces that are spoken together."""

    __slots__ = ("ids", "n", "texts")

    def __init__(self, text: str, n: int, ids: list[str]) -> None:
        self.texts, self.n, self.ids = [text], n, ids

    def add(self, other: _Chunk) -> None:
        self.texts += other.texts
        self.n += 1 + other.n
        self.ids += other.ids

    def cleaned(self) -> _Chunk:
        text = _EDGES.sub("", " ".join(self.texts))
        return _Chunk(text, _units(text), self.ids)


def _units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


class _Packer:
    """Takes a document's pieces in order and gives its chunks as soon as nothing can join them."""

    def __init__(self, limit: int, least: int) -> None:
        self.limit, self.least = limit, least
        self.open: _Chunk | None = None  # still being filled
        self.held: _Chunk | None = None  # full, but may still take a tiny neighbour

    def take(self, piece: _Chunk) -> Iterator[_Chunk]:
        if self.open is not None and (self.open.n == 0 or self.open.n + piece.n + 1 <= self.limit):
            self.open.add(piece)
            return
        yield from self._close()
        self.open = piece

    def _close(self) -> Iterator[_Chunk]:
        new = self.open.cleaned() if self.open is not None else None
        self.open = None
        if new is None or not new.n:
            return
        old = self.held
        if self.least > 1 and old is not None and (old.n < self.least or new.n < self.least) and old.n + 1 + new.n <= self.limit:
            old.add(new)
            return
        self.held = new
        if old is not None:
            yield old

    def end(self) -> Iterator[_Chunk]:
        yield from self._close()
        if self.held is not None:
            yield self.held
            self.held = None


def pack(parts: DataFrame, limit: int = 400, least: int = 0) -> DataFrame:
    """doc_id, chunk (0-based), text, segment_ids: pieces joined by spaces while they fit.

    With least above 1, a chunk joins the one before it when either is shorter and both fit.  A document's pieces are
    sorted in its partition and folded as they are read: no more than two chunks are held, however long the document.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, packer, number = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for key, segment, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if packer is None or key != doc:
                    if packer is not None:
                        out += [(doc, number + i, " ".join(c.texts), c.ids) for i, c in enumerate(packer.end())]
                    doc, packer, number = key, _Packer(limit, least), 0
                text = text or ""
                for c in packer.take(_Chunk(text, _units(text), [segment])):
                    out.append((doc, number, " ".join(c.texts), c.ids))
                    number += 1
            yield _rows(out, kinds)
        if packer is not None:
            yield _rows([(doc, number + i, " ".join(c.texts), c.ids) for i, c in enumerate(packer.end())], kinds)

    sorted_ = parts.repartition("doc_id").sortWithinPartitions("doc_id", "ord", "part", "segment_id", "piece").select("doc_id", "segment_id", "piece")
    schema = StructType([parts.schema["doc_id"], *StructType.fromDDL("chunk int, text string, segment_ids array<string>").fields])
    kinds = to_arrow_schema(schema)
    return sorted_.mapInArrow(fold, schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema, strict=True)], schema=schema)


def plan_chunks(segments: DataFrame, limit: int = 400, least: int = 0) -> DataFrame:
    if limit < 2:
        raise ValueError("limit must be 2 or more")
    return pack(pieces(segments, limit), limit, least)
