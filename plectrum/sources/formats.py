"""Document formats, ingest rules and archive limits over file metadata: native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plectrum.functions.text import rounded

# Extensions and MIME types of the formats, in the order of the checks.
EXTENSIONS = {
    "pdf": (".pdf",), "epub": (".epub",), "docx": (".docx",), "txt": (".txt", ".text"),
    "markdown": (".md", ".markdown", ".mdown", ".mkd"), "html": (".html", ".htm"),
}
_DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MIMES = {"pdf": "application/pdf", "epub": "application/epub+zip", "docx": _DOCX, "txt": "text/plain", "markdown": "text/markdown", "html": "text/html"}
#: Types that the ingest guard lets pass beside those of the formats; files often have none.
OTHER_MIMES = ("text/x-markdown", "")
MAX_DOCUMENT_BYTES = 50 * 1024 * 1024
# Audio types by request format, and those of exported files.
AUDIO_MIMES = {"mp3": "audio/mpeg", "wav": "audio/wav", "opus": "audio/opus", "flac": "audio/flac", "pcm": "audio/L16;rate=24000"}
EXPORT_MIMES = {"wav": "audio/wav", "mp3": "audio/mpeg", "m4a": "audio/mp4"}
#: Parser names that tell the type, in the order of the checks.
PARSERS = ("pdf", "epub", "docx", "markdown", "html", "txt")
LABELS = {"pdf": "PDF", "epub": "EPUB", "docx": "DOCX", "markdown": "Markdown", "html": "HTML", "txt": "TXT"}


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first case that holds."""
    out = otherwise
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def _ends(name: Column, endings: tuple[str, ...]) -> Column:
    return F.lower(name).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in endings) + r")\z")


def has_pdf_magic(head: Column) -> Column:
    return F.coalesce(F.startswith(F.hex(head), F.lit(b"%PDF-".hex().upper())), F.lit(False))


def has_zip_magic(head: Column) -> Column:
    return F.coalesce(F.startswith(F.hex(head), F.lit(b"PK\x03\x04".hex().upper())), F.lit(False))


def detect_format(name: Column, mime: Column, head: Column) -> Column:
    """The format by extension, else by MIME type, else by the first four bytes; null if none tells.

    An archive's magic tells nothing: it may be a book or a word-processor file.
    """
    by_name = [(_ends(name, ends), F.lit(f)) for f, ends in EXTENSIONS.items()]
    by_mime = [(mime == m, F.lit(f)) for f, m in MIMES.items()]
    by_head = [(F.startswith(F.hex(head), F.lit(b"%PDF".hex().upper())), F.lit("pdf"))]
    return _first([*by_name, *by_mime, *by_head], F.lit(None).cast("string"))


def reject_reason(name: Column, mime: Column, size: Column) -> Column:
    """Why a file is not taken in, or null: empty, above 50 MiB, or of another extension or type."""
    every = tuple(e for ends in EXTENSIONS.values() for e in ends)
    typed = _ends(name, every) & F.coalesce(mime, F.lit("")).isin(*MIMES.values(), *OTHER_MIMES)
    return F.when(size == 0, "empty_file").when(size > MAX_DOCUMENT_BYTES, "file_too_large").when(~typed, "unsupported_type")


def type_label(parser: Column) -> Column:
    """The lower-case type of a parser's documents, ``unknown`` for others."""
    return _first([(F.contains(parser, F.lit(p)), F.lit(p)) for p in PARSERS], F.lit("unknown"))


def shown_label(parser: Column, name: Column) -> Column:
    """The type as shown; for unknown parsers the file's extension in capitals."""
    tail = F.upper(F.element_at(F.split(name, r"\."), -1))
    return _first([(F.contains(parser, F.lit(p)), F.lit(LABELS[p])) for p in PARSERS], tail)


def audio_mime(fmt: Column) -> Column:
    return _first([(fmt == f, F.lit(m)) for f, m in AUDIO_MIMES.items()], F.lit("application/octet-stream"))


def export_mime(fmt: Column) -> Column:
    return _first([(fmt == f, F.lit(m)) for f, m in EXPORT_MIMES.items()], F.lit(None).cast("string"))


# --- archives ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ZipLimits:
    """Ceilings of an archive, checked on its directory before anything is inflated."""

    entries: int = 10_000
    entry_bytes: int = 64 * 1024 * 1024
    total_bytes: int = 256 * 1024 * 1024
    ratio: int = 100


def unsafe_path(name: Column) -> Column:
    """Absolute paths, drive letters and network shares."""
    return name.rlike(r"^(?:/|[A-Za-z]:[/\\]|\\\\)")


def zip_preflight(entries: DataFrame, by: str, limits: ZipLimits = ZipLimits()) -> DataFrame:
    """One row an archive: n_entries, total_bytes, largest_entry, largest_ratio and the first problem, or null.

    entries: by, ord, name, is_dir, size, packed (bytes; a null or negative size is unknown and only counted).
    The order of the checks is that of a reader: too many entries, then entry by entry unsafe paths and sizes,
    then the total, then the ratio.
    """
    known = ~F.col("is_dir") & (F.col("size") >= 0)
    ratio = F.when(known & (F.col("packed") > 0), F.col("size") / F.col("packed"))
    own = F.when(~F.col("is_dir") & unsafe_path(F.col("name")), "unsafe_path").when(known & (F.col("size") > limits.entry_bytes), "entry_too_large")
    told = entries.withColumns({"_own": own, "_ratio": ratio})
    sums = told.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.coalesce(F.sum(F.when(known, F.col("size"))), F.lit(0)).cast("long").alias("total_bytes"),
        F.max(F.when(known, F.col("size"))).cast("long").alias("largest_entry"),
        rounded(F.max("_ratio"), 3).alias("largest_ratio"),
        F.max("_ratio").alias("_worst"),
        F.min_by("_own", F.when(F.col("_own").isNotNull(), F.col("ord"))).alias("_own"),
    )
    problem = (
        F.when(F.col("n_entries") > limits.entries, "too_many_entries")
        .when(F.col("_own").isNotNull(), F.col("_own"))
        .when(F.col("total_bytes") > limits.total_bytes, "total_too_large")
        .when(F.col("_worst") > limits.ratio, "extreme_ratio")
    )
    return sums.withColumn("problem", problem).drop("_own", "_worst")


def inflated_too_far(size: Column, limits: ZipLimits = ZipLimits()) -> Column:
    """Whether an entry's real bytes break the ceiling, whatever its directory said."""
    return size > limits.entry_bytes


# --- adapters ---------------------------------------------------------------------------------------

#: A reader of one format: a table (doc_id, content) to blocks.
Adapter = Callable[[DataFrame], DataFrame]
_ADAPTERS: dict[str, Adapter] = {}


def register_adapter(fmt: str, adapter: Adapter) -> None:
    _ADAPTERS[fmt] = adapter


def adapter_for(fmt: str) -> Adapter | None:
    return _ADAPTERS.get(fmt)


def blocks_of(files: DataFrame) -> DataFrame:
    """The blocks of files (doc_id, name, mime, content) of all formats that have an adapter.

    Each format is a filter on the detected format and its reader; the results are united.
    """
    told = files.withColumn("_format", detect_format(F.col("name"), F.col("mime"), F.substring("content", 1, 4)))
    parts = [read(told.where(F.col("_format") == fmt).select("doc_id", "content")) for fmt, read in sorted(_ADAPTERS.items())]
    if not parts:
        raise ValueError("no adapter is registered")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
